"""Export plans: which source frames a timeline plays, in which order, and how they are written down."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from shotweave.functions import expr as X
from shotweave.operators.ordered import chunk_of, keyed, ordered_scan
from shotweave.operators.timeline import TL, groups_match, is_gap, place_in_range


@dataclass(frozen=True)
class ExportOptions:
    include_gaps: bool = False
    use_render_range: bool = True
    group_ids: Sequence | None = None
    include_untagged: bool = False
    gap_fps: float = 24.0


def _in_scope(items, timelines, opts: ExportOptions) -> DataFrame:
    """Items in range that pass the gap and tag flags; their sources are not looked at."""
    rows = place_in_range(items, timelines, opts.use_render_range)
    keep = groups_match(opts.group_ids, opts.include_untagged)
    return rows.where(F.when(is_gap(), F.lit(opts.include_gaps)).otherwise(keep))


def export_plan(items: DataFrame, sources: DataFrame, timelines: DataFrame,
                opts: ExportOptions = ExportOptions()) -> DataFrame:
    """One row per exported piece: source position and length, rate, and both timeline offsets.

    Items whose source is missing are skipped. ``offset_packed`` counts kept real pieces only,
    ``offset_in_range`` is the distance from the start of the range.
    """
    rows = _in_scope(items, timelines, opts)
    source = keyed("source_id", sources, items)
    src = sources.select(*source, "file_path", F.col("fps").alias("__fps"), F.lit(True).alias("__found"), F.lit(0).cast("long").alias("__spread"))
    # gaps have no source: their null ids are spread instead of meeting in one partition
    rows = rows.withColumn("__spread", F.when(is_gap(), F.pmod("item_ix", F.lit(1024)) + 1).otherwise(F.lit(0)).cast("long"))
    rows = rows.join(src, [*source, "__spread"], "left").where(is_gap() | F.col("__found"))
    plan = rows.select(
        TL, "item_ix", "clip_id", "source_id", "file_path", "label", "color_index", "src_in", "frame_count",
        F.when(is_gap(), F.lit(opts.gap_fps)).otherwise(F.col("__fps")).alias("fps"),
        (F.col("eff_start") - F.col("range_start")).alias("offset_in_range"))
    return layout_offsets(plan)


def layout_offsets(plan: DataFrame) -> DataFrame:
    """Add offset_packed, the running length of the real pieces before a row."""
    return ordered_scan(plan, [TL], ["item_ix"], chunk_of("item_ix"),
                        sums={"offset_packed": F.when(is_gap(), 0).otherwise(F.col("frame_count"))})


def export_extent(items, timelines, opts: ExportOptions = ExportOptions()) -> DataFrame:
    """Real pieces and frames per timeline under the flags; missing sources still count."""
    return _in_scope(items, timelines, opts).groupBy(TL).agg(
        F.count_if(~is_gap()).alias("n_clips"), F.sum("frame_count").alias("n_frames"))


def used_sources(items, timelines, opts: ExportOptions = ExportOptions()) -> DataFrame:
    """Sources a timeline would export, with the position of first use and its rank."""
    rows = _in_scope(items, timelines, opts).where(~is_gap())
    first = rows.groupBy(TL, "source_id").agg(F.min("item_ix").alias("first_ix"))
    return ordered_scan(first, [TL], ["first_ix"], chunk_of("first_ix"), index="use_ix")


def audio_summary(items, timelines, sources, opts: ExportOptions = ExportOptions()) -> DataFrame:
    """One-line audio description per timeline.

    The least and greatest non-silent description and a silent flag decide all four answers, so no set
    of descriptions is ever collected.
    """
    rows = _in_scope(items, timelines, opts).where(~is_gap()).select(TL, "source_id")
    source = keyed("source_id", sources, items)
    desc = sources.select(*source, X.audio_text("audio_codec", "audio_channels", "audio_sample_rate").alias("d"))
    loud = F.when(F.col("d") != "none", F.col("d"))
    agg = rows.join(desc, source).groupBy(TL).agg(
        F.min(loud).alias("lo"), F.max(loud).alias("hi"), F.max(F.col("d") == "none").alias("silent"))
    text = (F.when(F.col("lo").isNull(), "none")
            .when(F.col("lo") != F.col("hi"), "mixed")
            .when(F.col("silent"), F.concat(F.lit("mixed ("), F.col("lo"), F.lit(" and silent)")))
            .otherwise(F.col("lo")))
    base = items.select(TL).distinct()
    return base.join(agg.select(TL, text.alias("t")), TL, "left").select(TL, F.coalesce("t", F.lit("none")).alias("audio"))


def interchange_rows(plan: DataFrame, seq_fps=None) -> DataFrame:
    """Rational times for the XML form and nudged starts for the JSON form.

    ``seq_fps`` is the sequence rate (a number or column); default: each piece's own rate.
    """
    fps = F.col("fps") if seq_fps is None else X._c(seq_fps)
    p = plan.withColumn("__d", X.frame_duration(fps)).withColumns(
        {"rate_num": F.col("__d.num"), "rate_den": F.col("__d.den")}).drop("__d")
    return p.withColumns({
        "start_text": F.when(is_gap(), F.lit("0s")).otherwise(X.src_seek_str("src_in", "rate_num", "rate_den")),
        "duration_text": X.time_str("frame_count", "rate_num", "rate_den"),
        "offset_packed_text": X.time_str("offset_packed", "rate_num", "rate_den"),
        "offset_range_text": X.time_str("offset_in_range", "rate_num", "rate_den"),
        "start_value": F.when(is_gap(), F.lit(0.0)).otherwise(X.otio_start("src_in")),
    })


def frame_export_order(plan: DataFrame) -> DataFrame:
    """Image-sequence order: the frames of each source (first use first, ascending), gap frames last.

    Returns pieces with ``phase`` (0 source, 1 gap), the source's first use and the source position; sort
    by these to stream frames out.
    """
    real = plan.where(~is_gap())
    first = real.groupBy(TL, "source_id").agg(F.min("item_ix").alias("source_order"))
    a = real.join(first, [TL, "source_id"]).select(
        TL, F.lit(0).alias("phase"), "source_order", "source_id", "src_in", "frame_count", "item_ix")
    b = plan.where(is_gap()).select(
        TL, F.lit(1).alias("phase"), F.lit(None).cast("long").alias("source_order"), "source_id",
        F.lit(0).cast("long").alias("src_in"), "frame_count", "item_ix")
    return a.unionByName(b)
