"""From timelines to detected shots and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shotweave.operators import detect as dt
from shotweave.operators.edits import derived_id, replace_items
from shotweave.operators.timeline import TL, is_gap, place_in_range
from shotweave.session import materialize


def detect_segments(items: DataFrame, timelines: DataFrame) -> DataFrame:
    """Real items clamped to their timeline's range, with the left-out head and tail as prefix / suffix."""
    rows = place_in_range(items, timelines).where(~is_gap())
    seg_in = F.col("source_in") + F.col("eff_start") - F.col("tl_start")
    seg_out = F.col("source_in") + F.col("eff_end") - F.col("tl_start")
    head, tail = seg_in > F.col("source_in"), seg_out < F.col("source_out")
    return rows.select(
        TL, "item_ix", "clip_id", "source_id", seg_in.alias("seg_in"), seg_out.alias("seg_out"),
        F.when(head, F.col("source_in")).alias("prefix_in"), F.when(head, seg_in - 1).alias("prefix_out"),
        F.when(tail, seg_out + 1).alias("suffix_in"), F.when(tail, F.col("source_out")).alias("suffix_out"))


def as_segments(segments: DataFrame) -> DataFrame:
    return segments.select(TL, "clip_id", "source_id", F.col("seg_in").alias("source_in"), F.col("seg_out").alias("source_out"))


def reattach_partials(shots: DataFrame, segments: DataFrame) -> DataFrame:
    """Put the unanalysed head and tail of an item back around its shots."""
    cols = [TL, "clip_id", "source_id", "sub_ix", "source_in", "source_out"]
    head = segments.where("prefix_in is not null").select(
        TL, "clip_id", "source_id", F.lit(-1).cast("long").alias("sub_ix"), F.col("prefix_in").alias("source_in"), F.col("prefix_out").alias("source_out"))
    tail = segments.where("suffix_in is not null").select(
        TL, "clip_id", "source_id", F.lit(1 << 40).cast("long").alias("sub_ix"), F.col("suffix_in").alias("source_in"), F.col("suffix_out").alias("source_out"))
    return shots.select(*cols).unionByName(head).unionByName(tail)


def detect_shots(items: DataFrame, timelines: DataFrame, frames: DataFrame, detector: str = "diff", *,
                 threshold: float | None = None, kind: str = "scalar", scorer=dt.change_scorer, convention: str = "last",
                 color_start: int = 0) -> DataFrame:
    """Replace every analysed item by its shots.

    ``detector``: "diff" (frame features), "score" (a table of frame scores) or "model" (windows scored by
    ``scorer``). Cuts are found once per source and then assigned to the segments, except for "model",
    whose edge padding depends on the segment.
    """
    segments = materialize(detect_segments(items, timelines))
    spans = as_segments(segments)
    if detector == "diff":
        cuts = dt.cuts_in_segments(dt.detect_cuts_diff(frames, dt.DIFF_THRESHOLD if threshold is None else threshold, kind), spans)
    elif detector == "score":
        cuts = dt.cuts_in_segments(dt.detect_cuts_score(frames, dt.SCORE_THRESHOLD if threshold is None else threshold), spans)
    elif detector == "model":
        scores = dt.score_windows(frames, spans, scorer)
        cuts = scores.where(F.col("score") > (dt.SCORE_THRESHOLD if threshold is None else threshold)).select(
            TL, "clip_id", F.col("frame_ix").alias("cut_frame"))
    else:
        raise ValueError(f"unknown detector {detector!r}")
    shots = dt.cuts_to_shots(materialize(cuts), spans, convention)
    parts = materialize(reattach_partials(shots, segments))
    repl = parts.withColumn("new_clip_id", derived_id("clip_id", F.concat(F.lit("shot"), F.col("sub_ix"))))
    return replace_items(items, repl, color_start=color_start)
