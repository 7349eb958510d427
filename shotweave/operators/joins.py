"""Lookups along an order: positions to items, timestamps to packets, frames to keys and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shotweave.operators.ordered import asof_join, chunk_of, keyed, ordered_scan
from shotweave.operators.timeline import TL, clip_runs, is_gap, place_items


def locate_frames(items: DataFrame, points: DataFrame, col: str = "tl_frame", width: int = 65536) -> DataFrame:
    """Item, offset and source frame under timeline positions (timeline_id, tl_frame, …).

    Positions are looked up once each (duplicates rejoin afterwards by equality), as the last item that
    starts at or before them. On gaps source_frame is null; past the end everything is null.
    """
    placed = place_items(items).select(TL, "item_ix", "clip_id", "source_id", "source_in", "tl_start", "tl_end")
    spots = points.where(F.col(col) >= 0).select(TL, col).distinct()
    found = asof_join(spots, placed, [TL], col, "tl_start", width=width)
    found = found.where(F.col(col) <= F.col("tl_end")).select(
        TL, col, "item_ix", "clip_id", "source_id", (F.col(col) - F.col("tl_start")).alias("offset"),
        F.when(~is_gap(), F.col("source_in") + F.col(col) - F.col("tl_start")).alias("source_frame"))
    return points.join(found, [TL, col], "left")


def run_to_gap(items: DataFrame, points: DataFrame, col: str = "tl_frame") -> DataFrame:
    """For every position, the real items of its uninterrupted run up to the item under it; on a gap the
    run ends with the item just before. One output row per (point, item)."""
    located = locate_frames(items, points.select(TL, col).distinct(), col).where(F.col("item_ix").isNotNull())
    before = items.select(TL, "item_ix", "source_id")
    prior = ordered_scan(before, [TL], ["item_ix"], chunk_of("item_ix"),
                         prev={"__prev": F.when(~is_gap(), F.col("item_ix"))}).select(TL, "item_ix", "__prev")
    ends = located.join(prior, [TL, "item_ix"]).select(
        TL, col, F.when(is_gap(), F.col("__prev")).otherwise(F.col("item_ix")).alias("__end")).where("__end is not null")
    runs = clip_runs(items).select(TL, "item_ix", "clip_id", "run_id")
    tagged = ends.join(runs.select(TL, F.col("item_ix").alias("__end"), "run_id"), [TL, "__end"])
    return tagged.join(runs, [TL, "run_id"]).where(F.col("item_ix") <= F.col("__end")).select(TL, col, "item_ix", "clip_id")


def bracket_pts(seeks: DataFrame, packets: DataFrame, seek_col: str = "seek", width: float = 64.0) -> DataFrame:
    """Index of the latest packet at or before a seek time (source_id, seek, start_time).

    0 when the seek precedes the first packet, −1 when the source has no packets.
    """
    own = keyed("source_id", seeks, packets)
    s = seeks.withColumn("__t", F.col(seek_col) - F.coalesce(F.col("start_time"), F.lit(0.0)))
    # equal seeks are looked up once, and rejoin by equality
    out = asof_join(s.select(*own, "__t").distinct(), packets.select(*own, "pts_time", "pts_ix"), own, "__t", "pts_time", width=width, tie=["pts_ix"])
    have = packets.select(*own).distinct().withColumn("__have", F.lit(True))
    found = out.join(have, own, "left").select(
        *own, "__t", F.when(F.col("__have").isNull(), F.lit(-1)).otherwise(F.coalesce("pts_ix", F.lit(0))).cast("long").alias("__k"))
    by = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*own, "__t")]
    on = by[0]
    for b in by[1:]:
        on = on & b
    return s.alias("s").join(found.alias("f"), on, "left").select("s.*", F.coalesce("f.__k", F.lit(-1)).cast("long").alias("pts_k")).drop("__t")


def neighbour_keys(points: DataFrame, keyframes: DataFrame, col: str = "frame", width: int = 65536) -> DataFrame:
    """Strictly previous and next key frame of (crop_id, axis, frame)."""
    keys = [*keyed("crop_id", points, keyframes), "axis"]
    spots = points.select(*keys, col).distinct()
    back = asof_join(spots, keyframes.select(*keys, F.col("source_frame").alias("prev_key")), keys, col, "prev_key",
                     width=width, strict=True)
    both = asof_join(back, keyframes.select(*keys, F.col("source_frame").alias("next_key")), keys, col, "next_key",
                     width=width, strict=True, direction="forward")
    return points.join(both, [*keys, col], "left")


def first_frame_at_or_after(targets: DataFrame, frames: DataFrame, target_col: str, pts_col: str, width: float) -> DataFrame:
    """First decoded frame whose pts reaches each target; rows without one are dropped. Equal targets are looked up once."""
    own = keyed("source_id", targets, frames)
    out = asof_join(targets.select(*own, target_col).distinct(), frames, own, target_col, pts_col, width=width, direction="forward")
    return targets.join(out.where(F.col(pts_col).isNotNull()), [*own, target_col])


def nearest_frame(wanted: DataFrame, cached: DataFrame, col: str = "frame", tolerance: int = 3) -> DataFrame:
    """Closest cached frame within ``tolerance`` (the earlier one on ties).

    The tolerance is a small constant, so each wanted frame simply probes its 2·tolerance+1 neighbours by
    equality: no group is ever scanned.
    """
    own = keyed("source_id", wanted, cached)
    probes = wanted.select(*own, col).distinct().withColumn(
        "__d", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))))
    have = cached.select(*own, F.col("frame_ix").alias("__hit")).distinct()
    hits = probes.withColumn("__hit", F.col(col) + F.col("__d")).join(have, [*own, "__hit"])
    best = hits.groupBy(*own, col).agg(F.min_by("__hit", F.struct(F.abs("__d"), "__hit")).alias("nearest"))
    return wanted.join(best, [*own, col])


def pair_by_ordinal(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str],
                    left_chunk, right_chunk) -> DataFrame:
    """Pair rows of both sides by position inside a key; ``count_mismatch`` marks keys of unequal length."""
    l = ordered_scan(left, keys, left_order, left_chunk, index="ordinal", totals={"__ln": F.lit(1)})
    r = ordered_scan(right, keys, right_order, right_chunk, index="ordinal", totals={"__rn": F.lit(1)})
    l = l.select(*keys, "ordinal", "__ln", *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys])
    r = r.select(*keys, "ordinal", "__rn", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    # a row without a partner proves the mismatch; a paired row sees both totals
    out = l.join(r, [*keys, "ordinal"], "full_outer")
    return out.withColumn("count_mismatch", F.coalesce(F.col("__ln") != F.col("__rn"), F.lit(True))).drop("__ln", "__rn")


def segment_overlaps(segments: DataFrame, length_col: str = "window_frames", anchor_col: str = "anchor") -> DataFrame:
    """Pairs of one crop's export windows that share frames, with the shared half-open span.

    All windows of a crop have one length n, so two overlap exactly when their anchors differ by less
    than n: anchors are binned by n and only meet the same and the next bin. Windows with equal anchors
    form a complete set of pairs by definition; every emitted row is a true overlap.
    """
    own = keyed("crop_id", segments)
    a = segments.select(*own, "segment_ix", F.col(anchor_col).alias("__a"), F.col(length_col).alias("__n"))
    a = a.withColumn("__bin", F.floor(F.col("__a") / F.col("__n")).cast("long"))
    l = a.select(*own, "__bin", F.col("segment_ix").alias("__i1"), F.col("__a").alias("__a1"), "__n")
    r = a.select(*own, F.explode(F.array(F.col("__bin"), F.col("__bin") - 1)).alias("__bin"),
                 F.col("segment_ix").alias("__i2"), F.col("__a").alias("__a2"))
    # l is the earlier window (ties by index), r lies in the same or the next bin
    pairs = l.join(r, [*own, "__bin"]).where(
        ((F.col("__a1") < F.col("__a2")) | ((F.col("__a1") == F.col("__a2")) & (F.col("__i1") < F.col("__i2"))))
        & (F.col("__a2") < F.col("__a1") + F.col("__n")))
    return pairs.select(*own, F.least("__i1", "__i2").alias("ix_a"), F.greatest("__i1", "__i2").alias("ix_b"),
                        F.col("__a2").alias("shared_lo"), (F.col("__a1") + F.col("__n")).alias("shared_hi"))


def skip_cached(targets: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    return targets if force else targets.join(cached, [*keyed("source_id", targets, cached), "frame"], "left_anti")


def selected(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select(TL, "clip_id"), [TL, "clip_id"], "left_semi")


def route_crops(crops: DataFrame, folders: DataFrame) -> DataFrame:
    """Output folder per crop by tag; the null tag is a bucket of its own, crops without a folder drop."""
    own = keyed("group_id", crops, folders)
    f = folders.where(F.coalesce("folder", F.lit("")) != "").select(*(F.col(c).alias(f"__{c}") for c in own), "folder")
    same = F.col("group_id").eqNullSafe(F.col("__group_id"))
    for c in own[:-1]:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return crops.join(f, same).drop(*(f"__{c}" for c in own))
