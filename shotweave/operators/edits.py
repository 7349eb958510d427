"""Batches of timeline edits. One call applies an edit table to many timelines and returns new tables.

Positions in an edit table refer to the timeline before the call. New ids are derived from the parent's
id, so reruns give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shotweave.operators.ordered import chunk_of, keyed, long_keys, ordered_scan, row_index, stored_if_long
from shotweave.session import materialize
from shotweave.operators.timeline import TL, duration, is_gap, merge_gaps, place_items, renumber


#: Place before every frame, where crops without segments stand.
NOWHERE = -(1 << 50)


def derived_id(parent, tag) -> Column:
    """Deterministic id of something made from ``parent``."""
    parent = F.col(parent) if isinstance(parent, str) else parent
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.left(F.sha2(F.concat(parent.cast("string"), F.lit(":"), tag.cast("string")), 256), F.lit(32))


def _gap_version(items: DataFrame, hit: Column) -> DataFrame:
    """Rows under ``hit`` turned into gaps of the same length."""
    t = {f.name: f.dataType for f in items.schema}
    blank = {
        "clip_id": derived_id("clip_id", "gap"), "source_id": F.lit(None).cast(t["source_id"]),
        "source_in": F.lit(0).cast("long"), "source_out": duration() - 1, "label": F.lit(""),
        "color_index": F.lit(0), "group_ids": F.expr("array()").cast(t["group_ids"]) if "group_ids" in t else None,
    }
    return items.select(*[F.when(hit, blank[c]).otherwise(F.col(c)).cast(t[c]).alias(c) if blank.get(c) is not None else F.col(c)
                          for c in items.columns])


def _flagged(items: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    marks = ids.select(*on).distinct().withColumn("__hit", F.lit(True))
    return items.join(marks, list(on), "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def _merged(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``rows``, made of the items, with merged gaps and new numbers."""
    longer = long_keys(items, [TL])
    return renumber(stored_if_long(merge_gaps(stored_if_long(rows, longer), longer), longer), longer=longer)


def _remove(items: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    rows = _flagged(items, ids, on).where(~(F.col("__hit") & is_gap()))
    return _merged(_gap_version(rows, F.col("__hit")).select(*items.columns), items)


def remove_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Selected real items become gaps of equal length, selected gaps vanish, neighbouring gaps merge."""
    return _remove(items, ids, [TL, "clip_id"])


def ripple_delete(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Selected items vanish and later ones move up."""
    return _merged(items.join(ids.select(TL, "clip_id"), [TL, "clip_id"], "left_anti").select(*items.columns), items)


def remove_source(items: DataFrame, removed: DataFrame) -> DataFrame:
    """Every item of the given sources becomes a gap."""
    return _remove(items, removed, [c for c in (TL, "source_id") if c in removed.columns])


def ripple_source(items: DataFrame, removed: DataFrame) -> DataFrame:
    on = [c for c in (TL, "source_id") if c in removed.columns]
    return _merged(items.join(removed.select(*on), on, "left_anti").select(*items.columns), items)


# ---- cutting and inserting -----------------------------------------------------------

def _locate_cuts(placed: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """Item starts and cut marks of each timeline, to be put in one order."""
    cols = [c for c in placed.columns if c != TL]
    item = placed.select(TL, F.col("tl_start").alias("piece_start"), F.lit(0).alias("__kind"), F.struct(*cols).alias("__item"))
    if cuts is None:
        return item
    empty = F.lit(None).cast(item.schema["__item"].dataType)
    rest = [c for c in cuts.columns if c not in (TL, "cut")]
    marks = cuts.select(TL, F.col("cut").cast("long").alias("piece_start"), F.lit(1).alias("__kind"), empty.alias("__item"), *rest)
    return item.unionByName(marks, allowMissingColumns=True)


def _piece(item: Column, start: Column, following: Column, item_cols: list[str], fresh_left: bool) -> Column:
    """The part of ``item`` from ``start`` to before the next start, or null if there is none.

    Starts come from one ordered pass, so an item with very many cuts is never gathered into a row. Marks on an item's first
    frame or past the end yield empty or foreign pieces and drop out.
    """
    first, last = item["tl_start"], item["tl_end"]
    end = F.least(F.coalesce(following - 1, last), last)
    off, length = start - first, end - start + 1
    whole = (off == 0) & (end == last)
    keep_id = whole if fresh_left else (off == 0)
    gap = item["source_id"].isNull()
    values = {"clip_id": F.when(keep_id, item["clip_id"]).otherwise(derived_id(item["clip_id"], off)),
              "source_out": F.when(gap, length - 1).otherwise(item["source_in"] + off + length - 1),
              "source_in": F.when(gap, 0).otherwise(item["source_in"] + off).cast("long")}
    fields = [values.get(c, item[c]).alias(c) for c in item_cols]
    return F.when(item.isNotNull() & (end >= start), F.struct(*fields, item["clip_id"].alias("parent_id")))


def split_items(items: DataFrame, cuts: DataFrame, parents: bool = False) -> DataFrame:
    """Split real items at timeline frames (timeline_id, tl_frame[, clip_id]).

    A cut on the first frame of an item, on or after its last frame, on a gap, or under another item than
    the named one is ignored. Both halves get new ids and keep label, colour and tags. With ``parents``, the column ``parent_id``
    names the clip that a piece comes from, itself if it was not cut: ``partition_by_pieces`` takes it to hand on the crops.
    """
    cuts = cuts.select(TL, F.col("tl_frame").alias("cut"), *([F.col("clip_id").alias("__wanted")] if "clip_id" in cuts.columns else []))
    longer = long_keys(items.select(TL).unionByName(cuts.select(TL)), [TL])
    order, chunk = ["piece_start", "__kind"], chunk_of("piece_start")
    found = ordered_scan(stored_if_long(_locate_cuts(place_items(items, longer=longer), cuts), longer), [TL], order, chunk, fills={"__at": F.col("__item")}, longer=longer)
    ok = (F.col("__at.source_id").isNotNull() & (F.col("piece_start") > F.col("__at.tl_start"))
          & (F.col("piece_start") < F.col("__at.tl_end")))
    if "__wanted" in cuts.columns:
        ok = ok & (F.col("__wanted") == F.col("__at.clip_id"))
    rows = found.where((F.col("__kind") == 0) | ok).select(TL, "piece_start", "__kind", F.col("__at").alias("__item"))
    ends = ordered_scan(stored_if_long(rows, longer), [TL], order, chunk, following={"__next": F.col("piece_start")}, longer=longer)
    cols = [c for c in items.columns if c not in (TL, "item_ix")]
    pieces = ends.select(TL, "piece_start", _piece(F.col("__item"), F.col("piece_start"), F.col("__next"), cols, fresh_left=True).alias("p")).where("p is not null")
    # piece starts are unique within a timeline and follow its order
    out = row_index(stored_if_long(pieces, longer), [TL], ["piece_start"], chunk, "__ix", longer=longer)
    out = out.select(TL, (F.col("__ix") + 1).alias("item_ix"), "p.*")
    return out.select(*items.columns, *(["parent_id"] if parents else []))


def insert_items(items: DataFrame, inserts: DataFrame, parents: bool = False, color_start: int | None = None) -> DataFrame:
    """Insert clips (timeline_id, tl_frame, ins_ix, plus the item columns) and shift what follows.

    At or past the end they are appended, at or before 0 prepended; inside an item (gaps too) the item is
    cut. ``ins_ix`` orders clips that share a position. With ``color_start``, inserted real clips continue the eight-colour cycle from it, in the
    order in which they end up. With ``parents``, the column ``parent_id`` names the clip that a piece comes from, itself if it was not cut:
    ``partition_by_pieces`` takes it to hand on the crops.
    """
    cols = [c for c in items.columns if c not in (TL, "item_ix")]
    longer = long_keys(items.select(TL).unionByName(inserts.select(TL)), [TL])
    total = items.groupBy(TL).agg(F.sum(duration()).alias("__total"))
    pos = F.least(F.greatest(F.col("tl_frame"), F.lit(0)), F.coalesce("__total", F.lit(0))).cast("long")
    ins = inserts.join(total, TL, "left").select(TL, pos.alias("piece_start"), F.lit(-1).alias("__kind"), "ins_ix", F.struct(*cols).alias("__new"))
    # clips that go in come before the item or the right piece that starts at their place
    rows = _locate_cuts(place_items(items, longer=longer), None).unionByName(ins, allowMissingColumns=True)
    order, chunk = ["piece_start", "__kind", "ins_ix"], chunk_of("piece_start")
    turn = F.when(F.col("__new.source_id").isNotNull(), 1).otherwise(0)
    seen = ordered_scan(stored_if_long(rows, longer), [TL], order, chunk, sums={"__turn": turn}, following={"__next": F.col("piece_start")},
                        fills={"__at": F.col("__item")}, longer=longer)
    at, start = F.col("__at"), F.col("piece_start")
    # the last clip at a place inside an item is followed by the item's right piece
    inside = (start > at["tl_start"]) & (start <= at["tl_end"]) & (F.coalesce("__next", start + 1) > start)
    piece = _piece(F.when((F.col("__kind") == 0) | inside, at), start, F.col("__next"), cols, fresh_left=False)
    new = F.col("__new")
    if color_start is not None:
        kept = new["color_index"]
        color = F.when(new["source_id"].isNull(), kept).otherwise(F.pmod(F.col("__turn") + color_start, F.lit(8))).cast(items.schema["color_index"].dataType)
        new = F.struct(*[(color if c == "color_index" else new[c]).alias(c) for c in cols])
    made = seen.select(TL, *order, piece.alias("__piece"), F.when(F.col("__kind") < 0, F.struct(*[new[c].alias(c) for c in cols], new["clip_id"].alias("parent_id"))).alias("__clip"))
    n = F.when(F.col("__piece").isNotNull(), 1).otherwise(0) + F.when(F.col("__clip").isNotNull(), 1).otherwise(0)
    based = ordered_scan(stored_if_long(made, longer), [TL], order, chunk, sums={"__base": n}, longer=longer)
    out = based.select(TL, "__base", F.posexplode(F.array_compact(F.array("__clip", "__piece"))).alias("__sub", "p"))
    out = out.select(TL, (F.col("__base") + F.col("__sub") + 1).alias("item_ix"), "p.*")
    return out.select(*items.columns, *(["parent_id"] if parents else []))


def replace_items(items: DataFrame, repl: DataFrame, assign: bool = True, color_start: int = 0) -> DataFrame:
    """Substitute items by their replacement rows (timeline_id, clip_id, sub_ix, source_id, source_in,
    source_out, new_clip_id); items without replacements stay as they are.

    Replacements lose tags and labels. With ``assign`` they continue the eight-colour cycle.
    """
    t = {f.name: f.dataType for f in items.schema}
    r = ordered_scan(repl, [TL, "clip_id"], ["sub_ix"], chunk_of("sub_ix"), index="__sub",
                     sums={"__rr": F.when(F.col("source_id").isNull(), 0).otherwise(1)})
    n = repl.groupBy(TL, "clip_id").agg(F.count(F.lit(1)).alias("__n"), F.count("source_id").alias("__nr"))
    # an id that repeats inside a timeline is substituted at each of its places
    rows = items.join(n, [TL, "clip_id"], "left")
    # the join adds no row, so long timelines are found without it
    based = ordered_scan(rows, [TL], ["item_ix"], chunk_of("item_ix"), longer=long_keys(items, [TL]),
                         sums={"__base": F.coalesce("__n", F.lit(1)), "__cbase": F.coalesce("__nr", F.lit(0))})
    kept = based.where("__n is null").withColumn("item_ix", F.col("__base") + 1).select(*items.columns)
    heads = based.where("__n is not null").select(TL, "clip_id", "__base", "__cbase")
    new = heads.join(r, [TL, "clip_id"])
    color = F.pmod(F.col("__cbase") + F.col("__rr") + color_start, F.lit(8)) if assign else F.lit(0)
    values = {
        "item_ix": F.col("__base") + F.col("__sub") + 1, "clip_id": F.col("new_clip_id"), "label": F.lit(""),
        "color_index": F.when(F.col("source_id").isNull(), F.lit(0)).otherwise(color), "group_ids": F.expr("array()"),
    }
    new = new.select(*[(values[c] if c in values else F.col(c) if c in new.columns else F.lit(None)).cast(t[c]).alias(c)
                       for c in items.columns])
    return kept.unionByName(new)


def partition_crops(crops: DataFrame, segments: DataFrame, splits: DataFrame):
    """Distribute crops over the two halves of split clips (clip_id, split_frame, left_id, right_id).

    A segment follows its anchor; a crop appears on a half only with a segment there; a crop without
    segments stays left. Returns (crops, segments) with fresh ids on everything that was split; ``partition_by_pieces`` hands keys on as well.
    """
    clip, crop = keyed("clip_id", crops, splits), keyed("crop_id", crops, segments)
    on = splits.select(*clip, "split_frame", "left_id", "right_id", F.lit(True).alias("__split"))
    c = crops.join(on, clip, "left")
    cut = c.where("__split").select(*crop, "split_frame")
    s = segments.join(cut, crop, "left").withColumn(
        "side", F.when(F.col("split_frame").isNull(), None).when(F.col("anchor_frame") < F.col("split_frame"), "L").otherwise("R"))
    moved = F.col("side").isNotNull()
    new_segments = s.withColumns({
        "segment_id": F.when(moved, derived_id("segment_id", F.col("side"))).otherwise(F.col("segment_id")),
        "crop_id": F.when(moved, derived_id("crop_id", F.col("side"))).otherwise(F.col("crop_id"))}).select(*segments.columns)
    sides = s.where(moved).select(*crop, "side").distinct()
    split_crops = c.where("__split").join(sides, crop, "left").withColumn("side", F.coalesce("side", F.lit("L")))
    split_crops = split_crops.withColumns({
        "clip_id": F.when(F.col("side") == "L", F.col("left_id")).otherwise(F.col("right_id")),
        "crop_id": derived_id("crop_id", F.col("side"))})
    return c.where("__split is null").select(*crops.columns).unionByName(split_crops.select(*crops.columns)), new_segments


# ---- tags --------------------------------------------------------------------------------

def partition_by_pieces(crops: DataFrame, segments: DataFrame, keyframes: DataFrame, pieces: DataFrame):
    """Hand the crops of cut clips on to any number of pieces: ``pieces`` is the result of ``split_items`` or ``insert_items`` with ``parents``.

    A segment follows its anchor (before the clip it goes to the first piece, after it to the last); a crop appears on every piece
    that has one of its segments, with a copy of its keys; a crop without segments goes to the first piece. Ids of what is handed on
    come from the old id and the piece, so they are unique however many cuts there are. Returns (crops, segments, keyframes).
    """
    clip, on_crop = [TL, "clip_id"], keyed("crop_id", segments, crops)
    pieces = materialize(pieces.select(TL, F.col("parent_id").alias("clip_id"), F.col("clip_id").alias("piece"), F.col("source_in").cast("long").alias("at")))
    # every crop with each of its segments, or with none; segments without a crop have no clip and stay as they are
    inner = [c for c in segments.columns if c not in on_crop]
    both = crops.select(*dict.fromkeys([*clip, *on_crop])).withColumn("__crop", F.lit(True))
    both = both.join(segments.select(*on_crop, F.struct(*inner).alias("__segment")), on_crop, "full_outer")
    both = both.withColumns({"at": F.coalesce(F.col("__segment.anchor_frame").cast("long"), F.lit(NOWHERE)), "__kind": F.lit(1)})
    # pieces and segments of a clip in one order, so that very many of them never form all pairs
    rows = pieces.withColumn("__kind", F.lit(0)).unionByName(both, allowMissingColumns=True)
    longer = long_keys(pieces.select(*clip).unionByName(crops.join(segments.select(*on_crop), on_crop, "left").select(*clip)), clip)
    found = ordered_scan(stored_if_long(rows, longer), clip, ["at", "__kind"], chunk_of("at"), fills={"__under": F.col("piece")}, firsts={"__first": F.col("piece")},
                         totals={"__moved": F.when(F.col("piece") != F.col("clip_id"), 1).otherwise(0)}, longer=longer)
    # an insert leaves the first piece the old id, so a clip is cut if any piece has another one
    piece = F.when((F.col("__moved") > 0) & F.col("clip_id").isNotNull(), F.coalesce("__under", "__first"))
    found = found.where("__kind = 1").withColumn("piece", piece)
    moved = F.col("piece").isNotNull()

    def handed_id(c):
        return F.when(moved, derived_id(c, F.col("piece"))).otherwise(F.col(c)).alias(c)

    new_segments = found.where("__segment is not null").select(*on_crop, "piece", "__segment.*").select(
        *[handed_id(c) if c in ("crop_id", "segment_id") else F.col(c) for c in segments.columns])
    where = found.where(moved & F.col("__crop")).select(TL, "crop_id", "piece").distinct()

    def handed(rows):
        key = keyed("crop_id", rows, where)
        out = rows.join(where.select(*key, "piece"), key, "left")
        clip_id = F.coalesce("piece", "clip_id").alias("clip_id") if "clip_id" in rows.columns else None
        return out.select(*[handed_id(c) if c == "crop_id" else clip_id if c == "clip_id" else F.col(c) for c in rows.columns])

    return handed(crops), new_segments, handed(keyframes)


def toggle_group(items: DataFrame, targets: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Toggle tags on item sets (timeline_id, clip_id, group_id).

    If every targeted real item of a timeline already has the tag it is removed from all of them,
    otherwise it is appended where missing. Unregistered tags and gaps are ignored.
    """
    t = targets.select(TL, "clip_id", "group_id").distinct()
    if groups is not None:
        t = t.join(groups.select(*[c for c in (TL, "group_id") if c in groups.columns]),
                   [c for c in (TL, "group_id") if c in groups.columns], "left_semi")
    real = items.where(~is_gap()).select(TL, "clip_id", "group_ids")
    hit = t.join(real, [TL, "clip_id"]).withColumn("__has", F.array_contains("group_ids", F.col("group_id")))
    verdict = hit.groupBy(TL, "group_id").agg(F.bool_and("__has").alias("__all"))
    act = hit.join(verdict, [TL, "group_id"])
    per_item = act.groupBy(TL, "clip_id").agg(
        F.collect_list(F.when(F.col("__all"), F.col("group_id"))).alias("__del"),
        F.array_sort(F.collect_list(F.when(~F.col("__all") & ~F.col("__has"), F.col("group_id")))).alias("__add"))
    rows = items.join(per_item, [TL, "clip_id"], "left")
    changed = F.concat(F.filter("group_ids", lambda g: ~F.array_contains(F.col("__del"), g)), F.col("__add"))
    hit_row = F.col("__del").isNotNull() & ~is_gap()
    return rows.withColumn("group_ids", F.when(hit_row, changed).otherwise(F.col("group_ids"))).select(*items.columns)


def delete_groups(items: DataFrame, crops: DataFrame, groups: DataFrame, deleted: DataFrame):
    """Drop tags from the registry, strip them from items, clear them on crops."""
    keys = [c for c in (TL,) if c in deleted.columns]
    gone = deleted.select(*keys, "group_id").distinct()
    tags = items.where(F.size("group_ids") > 0).select(TL, "item_ix", F.posexplode("group_ids").alias("__pos", "group_id"))
    left = (tags.join(gone, [*keys, "group_id"], "left_anti").groupBy(TL, "item_ix")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "group_id"))), lambda s: s["group_id"]).alias("__kept")))
    empty = F.expr("array()").cast(items.schema["group_ids"].dataType)
    new_items = items.join(left, [TL, "item_ix"], "left").withColumn("group_ids", F.coalesce("__kept", empty)).select(*items.columns)
    mark = gone.withColumn("__gone", F.lit(True))
    new_crops = crops.join(mark, [*keys, "group_id"], "left").withColumn(
        "group_id", F.when(F.col("__gone").isNull(), F.col("group_id"))).select(*crops.columns)
    return new_items, new_crops, groups.join(gone, [*keys, "group_id"], "left_anti").select(*groups.columns)


def upsert_groups(groups: DataFrame, edits: DataFrame, keys: Sequence[str] = (TL,)):
    """Add or update tags. ``edits``: keys, edit_ix, group_id, name, color, digit, set_digit (is the
    digit part of the edit?); null name / color leave the old value.

    A digit held by another tag before the call, or claimed by an earlier edit of the call, is a conflict:
    the edit is not applied and is returned with the holder's name. Returns (groups, conflicts).
    """
    keys = list(keys)
    claims = edits.where(F.col("set_digit") & F.col("digit").isNotNull())
    holders = groups.where("digit is not null").select(*keys, "digit", F.col("group_id").alias("__h_id"), F.col("name").alias("__h_name"))
    first = claims.groupBy(*keys, "digit").agg(
        F.min("edit_ix").alias("__f_ix"), F.min_by("group_id", "edit_ix").alias("__f_id"), F.min_by("name", "edit_ix").alias("__f_name"))
    judged = claims.join(holders, [*keys, "digit"], "left").join(first, [*keys, "digit"], "left")
    by_holder = F.col("__h_id").isNotNull() & (F.col("__h_id") != F.col("group_id"))
    by_edit = (F.col("__f_ix") < F.col("edit_ix")) & (F.col("__f_id") != F.col("group_id"))
    conflicts = judged.where(by_holder | by_edit).select(
        *keys, "edit_ix", "group_id", "digit", F.when(by_holder, F.col("__h_name")).otherwise(F.col("__f_name")).alias("holder"))
    ok = edits.join(conflicts.select(*keys, "edit_ix"), [*keys, "edit_ix"], "left_anti")
    # later accepted edits of one tag win column by column
    latest = ok.groupBy(*keys, "group_id").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("edit_ix"))).alias("__name"),
        F.max_by("color", F.when(F.col("color").isNotNull(), F.col("edit_ix"))).alias("__color"),
        F.max_by("digit", F.when(F.col("set_digit"), F.col("edit_ix"))).alias("__digit"),
        F.bool_or("set_digit").alias("__set"))
    merged = groups.join(latest, [*keys, "group_id"], "full_outer")
    values = {
        "name": F.coalesce("__name", "name", F.lit("")), "color": F.coalesce("__color", "color", F.lit("#888888")),
        "digit": F.when(F.col("__set"), F.col("__digit")).otherwise(F.col("digit")),
    }
    return merged.select(*[values.get(c, F.col(c)).alias(c) for c in groups.columns]), conflicts


# ---- in / out points --------------------------------------------------------------------

def apply_marks(timelines: DataFrame, totals: DataFrame, marks: DataFrame) -> DataFrame:
    """Set in and out points (timeline_id, set_in, in_mark, set_out, out_mark), the in mark first.

    A mark that would cross the other one is rejected; one that lands on it pushes it by a frame when
    there is room. A null mark clears its side. ``totals``: timeline_id, tl_total.
    """
    t = timelines.join(marks, TL, "left").join(totals.select(TL, "tl_total"), TL, "left")
    t = t.withColumns({"set_in": F.coalesce("set_in", F.lit(False)), "set_out": F.coalesce("set_out", F.lit(False)),
                       "__last": F.coalesce("tl_total", F.lit(0)) - 1})
    m, out = F.col("in_mark"), F.col("out_point")
    both = F.col("set_in") & m.isNotNull() & out.isNotNull()
    on_out = both & ((m == out) | (m == out + 1))
    reject_in = F.coalesce((on_out & (m >= F.col("__last"))) | (both & ~on_out & (m > out)), F.lit(False))
    go_in = F.col("set_in") & ~reject_in
    t = t.withColumns({
        "__in1": F.when(go_in, m).otherwise(F.col("in_point")),
        "__out1": F.when(go_in & F.coalesce(on_out, F.lit(False)), m + 1).otherwise(out)})
    k, i1 = F.col("out_mark"), F.col("__in1")
    both2 = F.col("set_out") & k.isNotNull() & i1.isNotNull()
    on_in = both2 & (k == i1)
    reject_out = F.coalesce((on_in & (i1 <= 0)) | (both2 & (k < i1)), F.lit(False))
    go_out = F.col("set_out") & ~reject_out
    return t.withColumns({
        "in_point": F.when(go_out & F.coalesce(on_in, F.lit(False)), i1 - 1).otherwise(i1),
        "out_point": F.when(go_out, k).otherwise(F.col("__out1")),
        "in_rejected": reject_in, "out_rejected": reject_out,
    }).select(*timelines.columns, "in_rejected", "out_rejected")
