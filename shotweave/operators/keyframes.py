"""Animated crop geometry: sampling of keyframe tracks, key edits, nested and flat forms.

``keyframes``: timeline_id, crop_id, axis (x, y, w, h), source_frame (unique per crop and axis), value, interp, in_dx,
in_dy, out_dx, out_dy. Crop ids are unique within a timeline; tables of a single project may leave ``timeline_id`` out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shotweave.functions import expr as X
from shotweave.operators.ordered import asof_join, chunk_of, keyed, ordered_scan, overlap_join
from shotweave.session import materialize

SHAPE = ["value", "interp", "in_dx", "in_dy", "out_dx", "out_dy"]
NEWTON_STEPS = 8
# position before every key: the clamp row of a track sits here
BEFORE_ALL = -(1 << 50)


# ---- sampling ---------------------------------------------------------------------------

def key_pairs(keyframes: DataFrame, crop: list[str] | None = None) -> DataFrame:
    """Every key with the next key of its track (null on the last one) and its place in the track."""
    nxt = F.struct("source_frame", *SHAPE)
    keys = [*(crop or keyed("crop_id", keyframes)), "axis"]
    return ordered_scan(keyframes.select(*keys, "source_frame", *SHAPE), keys, ["source_frame"], chunk_of("source_frame"),
                        following={"next_key": nxt}, index="key_ix", totals={"n_keys": F.lit(1)})


def bezier_value(p0x, p0y, p1x, p1y, p2x, p2y, p3x, p3y, t) -> Column:
    """Value of a cubic curve at position t: invert x(u) = t by a few Newton steps, then evaluate y(u)."""
    p0x, p0y, p1x, p1y, p2x, p2y, p3x, p3y, t = (X._c(v).cast("double") for v in (p0x, p0y, p1x, p1y, p2x, p2y, p3x, p3y, t))

    def cubic(u, a, b, c, d):
        v = 1.0 - u
        return v * v * v * a + 3.0 * v * v * u * b + 3.0 * v * u * u * c + u * u * u * d

    def slope(u):
        v = 1.0 - u
        return 3.0 * v * v * (p1x - p0x) + 6.0 * v * u * (p2x - p1x) + 3.0 * u * u * (p3x - p2x)

    seed = (t - p0x) / F.greatest(F.lit(1e-9), p3x - p0x)

    def step(s, _):
        u = s["u"]
        dx = slope(u)
        flat = s["flat"] | (F.abs(dx) < 1e-6)
        moved = F.least(F.greatest(u - (cubic(u, p0x, p1x, p2x, p3x) - t) / F.when(flat, F.lit(1.0)).otherwise(dx), F.lit(0.0)), F.lit(1.0))
        return F.struct(F.when(flat, u).otherwise(moved).alias("u"), flat.alias("flat"))

    u = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.struct(seed.alias("u"), F.lit(False).alias("flat")), step, lambda s: s["u"])
    u = F.when(t <= p0x, F.lit(0.0)).when(t >= p3x, F.lit(1.0)).otherwise(u)
    # evaluate through a one-element array so the inversion is computed once
    return F.element_at(F.transform(F.array(u), lambda v: cubic(v, p0y, p1y, p2y, p3y)), 1)


def track_pieces(keyframes: DataFrame, points: DataFrame, width: int = 65536) -> DataFrame:
    """The piece of each axis' track that covers (crop_id, frame): key a, key b (null where the track is
    clamped) and whether b is the last key. One backward as-of lookup per distinct point and axis; tracks
    without keys give no row.

    A frame on an inner key belongs to the pair that ends there.
    """
    crop = keyed("crop_id", keyframes, points)
    keys = [*crop, "axis"]
    pairs = key_pairs(keyframes, crop)
    rows = pairs.select(*keys, F.col("source_frame").alias("a_pos"), F.struct("source_frame", *SHAPE).alias("a"),
                        F.col("next_key").alias("b"), (F.col("key_ix") == F.col("n_keys") - 2).alias("b_last"), "key_ix")
    none = F.lit(None).cast(rows.schema["b"].dataType)
    head = rows.where("key_ix = 0").select(*keys, F.lit(BEFORE_ALL).cast("long").alias("a_pos"), "a", none.alias("b"), F.lit(False).alias("b_last"))
    rows = rows.select(*keys, "a_pos", "a", "b", "b_last").unionByName(head)
    # one row per track; no point is expanded for axes that are not animated
    tracks = keyframes.select(*keys).distinct()
    wanted = points.select(*crop, "frame").distinct().join(tracks, crop)
    return asof_join(wanted, rows, keys, "frame", "a_pos", width=width, strict=True).drop("a_pos")


def piece_value(a: Column, b: Column, b_last: Column, t: Column) -> Column:
    """Value of a piece at frame t: clamped without b; step if the left key says so; bezier if either key
    does; else linear."""
    u = (t - a["source_frame"]) / (b["source_frame"] - a["source_frame"])
    bez = bezier_value(
        a["source_frame"], a["value"], a["source_frame"] + a["out_dx"], a["value"] + a["out_dy"],
        b["source_frame"] + b["in_dx"], b["value"] + b["in_dy"], b["source_frame"], b["value"], t)
    return (F.when(b.isNull(), a["value"])
            .when(b_last & (t >= b["source_frame"]), b["value"])
            .when(a["interp"] == "step", a["value"])
            .when((a["interp"] == "bezier") | (b["interp"] == "bezier"), bez)
            .otherwise(a["value"] + (b["value"] - a["value"]) * u))


def sample_tracks(keyframes: DataFrame, points: DataFrame, width: int = 65536) -> DataFrame:
    """Track value at each (crop_id, frame), per axis that has keys."""
    hit = track_pieces(keyframes, points, width)
    return hit.select(*keyed("crop_id", hit), "axis", "frame", piece_value(F.col("a"), F.col("b"), F.col("b_last"), F.col("frame")).alias("value"))


def locked_rect(x, y, w, h) -> list[Column]:
    """Rounded rectangle with the aspect lock applied: width drives height."""
    ar = X.resolve_aspect("aspect_ratio", "custom_ratio_w", "custom_ratio_h")
    height = F.when(ar.isNotNull() & (ar["num"] > 0) & (ar["den"] > 0), w * ar["den"] / ar["num"]).otherwise(h.cast("double"))
    return [X.rounded(x).alias("x"), X.rounded(y).alias("y"), X.rounded(w).alias("w"), X.rounded(height).alias("h")]


def sample_crops(crops: DataFrame, keyframes: DataFrame, points: DataFrame) -> DataFrame:
    """Crop rectangle at each (crop_id, frame): animated axes from their tracks, the others from the base."""
    crop = keyed("crop_id", crops, keyframes, points)
    pts = points.select(*crop, "frame").distinct()
    per_axis = sample_tracks(keyframes, pts)
    wide = per_axis.groupBy(*crop, "frame").agg(*[
        F.max(F.when(F.col("axis") == ax, F.col("value"))).alias(f"__{ax}") for ax in ("x", "y", "w", "h")])
    base = crops.select(*crop, "x", "y", "w", "h", "aspect_ratio", "custom_ratio_w", "custom_ratio_h")
    rows = pts.join(base, crop).join(wide, [*crop, "frame"], "left")
    v = {ax: F.coalesce(F.col(f"__{ax}"), F.col(ax).cast("double")) for ax in ("x", "y", "w", "h")}
    return rows.select(*crop, "frame", *locked_rect(v["x"], v["y"], v["w"], v["h"]))


def is_animated(crops: DataFrame, keyframes: DataFrame) -> DataFrame:
    crop = keyed("crop_id", crops, keyframes)
    moving = keyframes.select(*crop).distinct().withColumn("__m", F.lit(True))
    return crops.join(moving, crop, "left").withColumn("animated", F.coalesce("__m", F.lit(False))).drop("__m")


def keys_in_windows(keyframes: DataFrame, windows: DataFrame, width: int = 4096) -> DataFrame:
    """Distinct key frames of any axis inside [lo, hi) of each window (crop_id, window columns, lo, hi)."""
    crop = keyed("crop_id", keyframes, windows)
    k = keyframes.select(*crop, F.col("source_frame").alias("key_frame")).distinct().withColumn("__k", F.col("key_frame"))
    w = windows.where("hi > lo").withColumn("__last", F.col("hi") - 1)
    return overlap_join(k, w, crop, ("key_frame", "__k"), ("lo", "__last"), width=width).drop("__k", "__last")


# ---- key edits ------------------------------------------------------------------------------

def _slot(keyframes: DataFrame, edits: DataFrame) -> list[str]:
    return [*keyed("crop_id", keyframes, edits), "axis", "source_frame"]


def _latest(edits: DataFrame, slot: list[str]) -> DataFrame:
    rest = [c for c in edits.columns if c not in slot]
    return edits.groupBy(*slot).agg(F.max_by(F.struct(*rest), "edit_seq").alias("e"))


def upsert_keys(keyframes: DataFrame, edits: DataFrame) -> DataFrame:
    """Set keys (crop_id, axis, source_frame, value, interp, edit_seq). An existing key keeps its handles
    unless its interpolation changes at any of the edits; a new key has none."""
    slot = _slot(keyframes, edits)
    changes = edits.groupBy(*slot).agg(
        F.max_by(F.struct("value", "interp"), "edit_seq").alias("e"), F.min("interp").alias("__lo"), F.max("interp").alias("__hi"))
    k = keyframes.select(*slot, F.struct(*SHAPE).alias("k"))
    both = k.join(changes, slot, "full_outer")
    same = F.col("e").isNull() | ((F.col("__lo") == F.col("k.interp")) & (F.col("__hi") == F.col("k.interp")))

    def handle(c):
        return F.when(F.coalesce(same, F.lit(False)), F.col(f"k.{c}")).otherwise(F.lit(0.0)).alias(c)

    return both.select(*slot, F.coalesce(F.col("e.value"), F.col("k.value")).alias("value"),
                       F.coalesce(F.col("e.interp"), F.col("k.interp")).alias("interp"),
                       *[handle(c) for c in ("in_dx", "in_dy", "out_dx", "out_dy")])


def delete_keys(keyframes: DataFrame, edits: DataFrame) -> DataFrame:
    slot = _slot(keyframes, edits)
    return keyframes.join(edits.select(*slot), slot, "left_anti").select(*slot, *SHAPE)


def move_keys(keyframes: DataFrame, edits: DataFrame) -> DataFrame:
    """Move keys (crop_id, axis, old_frame, new_frame, new_value, edit_seq); a key at the destination is
    replaced, interpolation and handles travel. All moves see the keys as they were before the call."""
    slot = [*keyed("crop_id", keyframes, edits), "axis", "source_frame"]
    e = _latest(edits.withColumnRenamed("old_frame", "source_frame"), slot)
    hit = keyframes.join(e, slot, "left")
    moved = hit.where("e is not null").select(
        *slot[:-1], F.col("e.new_frame").alias("source_frame"), F.col("e.new_value").alias("value"),
        "interp", "in_dx", "in_dy", "out_dx", "out_dy", F.col("e.edit_seq").alias("edit_seq"))
    landed = _latest(moved, slot).select(*slot, *[F.col(f"e.{c}").alias(c) for c in SHAPE])
    stay = hit.where("e is null").select(*slot, *SHAPE).join(landed.select(*slot), slot, "left_anti")
    return stay.unionByName(landed)


def shape_keys(keyframes: DataFrame, edits: DataFrame) -> DataFrame:
    """Shape existing keys (…, interp, in_dx, in_dy, out_dx, out_dy, edit_seq): an edit with an
    interpolation sets it and the handles (missing ones to zero), one without sets the given handles only.
    Edits of missing keys are ignored."""
    handles = ["in_dx", "in_dy", "out_dx", "out_dy"]
    full = F.col("interp").isNotNull()
    slot = _slot(keyframes, edits)
    e = edits.select(*slot, "edit_seq", "interp", *[F.when(full, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)).alias(c) for c in handles])
    e = e.groupBy(*slot).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("edit_seq"))).alias(f"__{c}") for c in ["interp", *handles]])
    return keyframes.join(e, slot, "left").select(*slot, "value", *[F.coalesce(f"__{c}", c).alias(c) for c in ["interp", *handles]])


def pair_interp(keyframes: DataFrame, edits: DataFrame) -> DataFrame:
    """Set the interpolation of the keys both axes of a pair have at a frame (crop_id, pair "position" or
    "size", source_frame, interp, edit_seq). Handles stay."""
    axes = (F.when(F.col("pair") == "position", F.array(F.lit("x"), F.lit("y")))
            .when(F.col("pair") == "size", F.array(F.lit("w"), F.lit("h"))))
    slot = [*keyed("crop_id", keyframes, edits), "axis", "source_frame"]
    both = edits.select(*slot[:-2], F.explode(axes).alias("axis"), "source_frame", "interp", "edit_seq")
    e = _latest(both, slot).select(*slot, F.col("e.interp").alias("__i"))
    return keyframes.join(e, slot, "left").select(
        *slot, "value", F.coalesce("__i", "interp").alias("interp"), "in_dx", "in_dy", "out_dx", "out_dy")


def apply_key_edits(keyframes: DataFrame, moves=None, deletes=None, sets=None, shapes=None, pairs=None) -> DataFrame:
    """A batch of key edits, by kind and in this order: moves, deletes, sets, shapes, axis pairs."""
    out = keyframes.select(*keyed("crop_id", keyframes), "axis", "source_frame", *SHAPE)
    for fn, edits in ((move_keys, moves), (delete_keys, deletes), (upsert_keys, sets), (shape_keys, shapes), (pair_interp, pairs)):
        if edits is not None:
            out = fn(out, edits)
    return out


#: Kinds of an edit log, see ``edit_keys``.
EDIT_KINDS = ("set", "delete", "toggle", "move", "shape", "handles", "pair")
_HANDLES = ("in_dx", "in_dy", "out_dx", "out_dy")
_EDIT_FIELDS = {"kind": "string", "new_frame": "long", "value": "double", "interp": "string", **dict.fromkeys(_HANDLES, "double"), "edit_seq": "long"}


def _apply_edit(keys: dict[int, list], e: dict) -> None:
    """One edit of one track: ``keys`` maps frames to [value, interp, four handles]."""
    kind, at = e["kind"], e["source_frame"]
    key = keys.get(at)
    given = [e[h] for h in _HANDLES]
    if kind == "delete" or kind == "toggle" and key is not None:
        keys.pop(at, None)
    elif kind in ("set", "toggle"):
        interp = e["interp"] or "linear"
        # handles stay as long as the interpolation does
        keys[at] = [e["value"], interp, *(key[2:] if key is not None and key[1] == interp else (0.0,) * 4)]
    elif key is None:
        return
    elif kind == "move":
        del keys[at]
        keys[e["new_frame"]] = [e["value"], *key[1:]]
    elif kind == "shape":
        keys[at] = [key[0], e["interp"], *(h if h is not None else 0.0 for h in given)]
    elif kind == "handles":
        keys[at] = [*key[:2], *(h if h is not None else old for h, old in zip(given, key[2:], strict=True))]
    elif kind == "pair":
        keys[at] = [key[0], e["interp"], *key[2:]]


def edit_keys(keyframes: DataFrame, edits: DataFrame) -> DataFrame:
    """Keys after a log of edits, applied one after another by ``edit_seq`` (ties: by frame, then kind).

    ``edits``: the crop's key, ``axis`` (or ``pair``, "position" or "size", for the kind pair), ``kind``, ``source_frame``, ``edit_seq`` and what the kind needs:

    * set: ``value``, ``interp`` (linear if null); handles stay while the interpolation does, a new key has none; toggle: the same, or a delete if the key is there
    * delete; move: ``new_frame``, ``value``, replaces a key there, shape and handles travel
    * shape: ``interp`` and handles (null: zero); handles: those that are given; pair: ``interp`` of both axes that have a key at the frame

    Edits of missing keys do nothing, unknown kinds are an error. Keys that no edit names stay where they are; the others meet their edits in one sorted
    pass: by frame, or by track if the track has moves. A task holds the keys of one such unit at a time, whatever its number of edits.
    """
    crop = keyed("crop_id", keyframes, edits)
    track = [*crop, "axis"]
    log = edits.select(*crop, *(F.col(c) if c in edits.columns else F.lit(None).cast(t).alias(c) for c, t in {"axis": "string", "pair": "string", "source_frame": "long", **_EDIT_FIELDS}.items()))
    known = F.when(F.col("kind").isin(*EDIT_KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of key edit: "), F.coalesce("kind", F.lit("null")))))
    axes = (F.when(F.col("kind") != "pair", F.array("axis")).when(F.col("pair") == "position", F.array(F.lit("x"), F.lit("y")))
            .when(F.col("pair") == "size", F.array(F.lit("w"), F.lit("h"))))
    log = materialize(log.withColumn("kind", known).withColumn("axis", F.explode(axes)).drop("pair"))
    moving = log.where("kind = 'move'").select(*track).distinct().withColumn("__moves", F.lit(True))
    unit = F.when(F.col("__moves"), F.lit(None).cast("long")).otherwise(F.col("source_frame")).alias("unit")
    log = log.join(moving, track, "left")
    named = log.select(*track, F.explode(F.array_compact(F.array("source_frame", "new_frame"))).alias("source_frame")).distinct()
    slot = [*track, "source_frame"]
    keys = keyframes.select(*slot, *SHAPE)
    touched = keys.join(named, slot, "left_semi").join(moving, track, "left")
    none = {c: F.lit(None).cast(t).alias(c) for c, t in _EDIT_FIELDS.items()}
    rows = touched.select(*slot, unit, *(F.col(c) if c in SHAPE else none[c] for c in _EDIT_FIELDS)).unionByName(log.select(*slot, unit, *_EDIT_FIELDS))
    rows = rows.repartition(*track, "unit").sortWithinPartitions(*track, "unit", F.col("kind").isNotNull(), "edit_seq", "source_frame", "kind")
    schema = T.StructType([rows.schema[c] for c in slot] + [rows.schema[c] for c in SHAPE])
    arrow = to_arrow_schema(schema)

    def fold(batches):
        own, held = None, {}

        def flush():
            found = [[*own[:-1], f, *k] for f, k in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], arrow.field(k).type) for k in range(len(arrow))], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                here = (*(r[c] for c in track), r["unit"])
                if here != own:
                    if held:
                        yield flush()
                    own, held = here, {}
                if r["kind"] is None:
                    held[r["source_frame"]] = [r[c] for c in SHAPE]
                else:
                    _apply_edit(held, r)
        if held:
            yield flush()

    done = rows.mapInArrow(fold, schema)
    return keys.join(named, slot, "left_anti").unionByName(done)


# ---- nested and flat --------------------------------------------------------------------------

def flatten_crops(clips: DataFrame) -> dict[str, DataFrame]:
    """Split nested crops (timeline_id, clip_id, crop_regions) into crops, segments and keyframes.

    Defaults are filled in, the layout that had a single anchor becomes one segment, and a crop without
    segments gets one at frame 0.
    """
    c = clips.select("timeline_id", "clip_id", F.posexplode("crop_regions").alias("crop_ix", "c"))
    c = c.withColumns({
        "crop_ix": F.col("crop_ix").cast("long"),
        "crop_id": F.coalesce(F.when(F.col("c.id") != "", F.col("c.id")),
                              F.left(F.sha2(F.concat_ws(":", F.col("timeline_id").cast("string"), "clip_id", F.col("crop_ix").cast("string")), 256), F.lit(32)))})
    zero = F.lit(0).cast("long")
    crops = c.select(
        "timeline_id", "clip_id", "crop_ix", "crop_id",
        *[F.coalesce(f"c.{f}", zero).alias(f) for f in ("x", "y", "w", "h")],
        F.coalesce("c.aspect_ratio", F.lit("free")).alias("aspect_ratio"),
        F.coalesce("c.custom_ratio_w", zero).alias("custom_ratio_w"), F.coalesce("c.custom_ratio_h", zero).alias("custom_ratio_h"),
        F.when(F.col("c.group_id") != "", F.col("c.group_id")).alias("group_id"),
        F.coalesce("c.active", F.lit(True)).alias("active"), F.coalesce("c.label", F.lit("")).alias("label"))
    has_old = "anchor_frame" in clips.schema["crop_regions"].dataType.elementType.names
    one = F.array(F.struct(F.lit(None).cast("string").alias("id"), (F.coalesce("c.anchor_frame", zero) if has_old else zero).alias("anchor_frame"), F.lit(True).alias("active")))
    segs = F.when(F.coalesce(F.size("c.segments"), F.lit(0)) > 0, F.col("c.segments")).otherwise(one.cast("array<struct<id:string,anchor_frame:bigint,active:boolean>>"))
    s = c.select("timeline_id", "crop_id", F.posexplode(segs).alias("segment_ix", "s"))
    segments = s.select(
        "timeline_id", "crop_id", F.col("segment_ix").cast("long").alias("segment_ix"),
        F.coalesce(F.when(F.col("s.id") != "", F.col("s.id")), F.left(F.sha2(F.concat_ws(":", F.col("timeline_id").cast("string"), "crop_id", F.col("segment_ix").cast("string")), 256), F.lit(32))).alias("segment_id"),
        F.coalesce("s.anchor_frame", zero).alias("anchor_frame"), F.coalesce("s.active", F.lit(True)).alias("active"))
    tracks = F.array(*[F.struct(F.lit(ax).alias("axis"), F.col(f"c.{ax}_track.keys").alias("keys")) for ax in ("x", "y", "w", "h")])
    k = c.select("timeline_id", "crop_id", F.explode(tracks).alias("t")).select("timeline_id", "crop_id", "t.axis", F.explode("t.keys").alias("k"))

    def part(h, i):
        return F.coalesce(F.get(F.col(f"k.{h}"), F.lit(i)), F.lit(0.0))

    keys = k.select(
        "timeline_id", "crop_id", "axis", F.coalesce("k.source_frame", zero).alias("source_frame"), F.coalesce("k.value", F.lit(0.0)).alias("value"),
        F.when(F.col("k.interp").isin(*X.INTERPS), F.col("k.interp")).otherwise(F.lit("linear")).alias("interp"),
        part("in_handle", 0).alias("in_dx"), part("in_handle", 1).alias("in_dy"), part("out_handle", 0).alias("out_dx"), part("out_handle", 1).alias("out_dy"))
    return {"crops": crops, "segments": segments, "keyframes": keys}


def nest_crops(crops: DataFrame, segments: DataFrame, keyframes: DataFrame) -> DataFrame:
    """One nested document struct per crop (timeline_id, clip_id, crop_ix, crop). Tracks without keys are
    null, so they vanish from the text. The nested form is one row per crop by definition."""
    with_segments, with_keys = keyed("crop_id", crops, segments), keyed("crop_id", crops, keyframes)
    seg = segments.groupBy(*with_segments).agg(F.array_sort(F.collect_list(F.struct(
        "segment_ix", F.struct(F.col("segment_id").alias("id"), "anchor_frame", "active").alias("s")))).alias("__s"))
    key = F.struct("source_frame", "value", "interp", F.array("in_dx", "in_dy").alias("in_handle"), F.array("out_dx", "out_dy").alias("out_handle"))
    marked = keyframes.withColumn("__key", key)
    tracks = marked.groupBy(*with_keys).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("axis") == ax, F.col("__key")))).alias(f"__{ax}") for ax in ("x", "y", "w", "h")])
    rows = crops.join(seg, with_segments, "left").join(tracks, with_keys, "left")

    def track(ax):
        return F.when(F.size(f"__{ax}") > 0, F.struct(F.col(f"__{ax}").alias("keys"))).alias(f"{ax}_track")

    doc = F.struct(
        F.col("crop_id").alias("id"), "x", "y", "w", "h",
        F.coalesce(F.transform("__s", lambda v: v["s"]), F.array().cast("array<struct<id:string,anchor_frame:bigint,active:boolean>>")).alias("segments"),
        "aspect_ratio", "custom_ratio_w", "custom_ratio_h", "group_id", "active", "label", *[track(ax) for ax in ("x", "y", "w", "h")])
    return rows.select("timeline_id", "clip_id", "crop_ix", doc.alias("crop"))
