"""Thumbnail planning: which frames to fetch and in what pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shotweave.functions import expr as X
from shotweave.operators.joins import skip_cached
from shotweave.operators.ordered import chunk_of, keyed, ordered_scan
from shotweave.operators.timeline import is_gap, place_in_range
from shotweave.session import materialize

# ---- fixed values --------------------------------------------------------------------
SEQUENTIAL_GAP = 400
MAX_RUN = 16


def thumbnail_targets(items: DataFrame, timelines: DataFrame | None = None, cached: DataFrame | None = None, force: bool = False,
                      source: list[str] | None = None) -> DataFrame:
    """First and last source frame of every real item in range, each once per source, minus cached ones.

    ``source`` is the key of a source: its id alone where one project is at hand, else the id within the timeline.
    """
    rows = items if timelines is None else place_in_range(items, timelines)
    ends = rows.where(~is_gap()).select(*(source or ["source_id"]), F.explode(F.array("source_in", "source_out")).alias("frame"))
    targets = ends.distinct()
    return targets if cached is None else skip_cached(targets, cached, force)


def frame_runs(targets: DataFrame) -> DataFrame:
    """Number runs of targets that are at most 400 frames apart, and 16-frame chunks inside each run."""
    keys, order, chunk = keyed("source_id", targets), ["frame"], chunk_of("frame")
    flagged = ordered_scan(targets, keys, order, chunk, prev={"__p": F.col("frame")}, index="__rn")
    flagged = flagged.withColumn("__new", F.when(F.col("frame") - F.col("__p") <= SEQUENTIAL_GAP, 0).otherwise(1))
    flagged = materialize(flagged.withColumn("__start", F.when(F.col("__new") == 1, F.col("__rn"))))
    out = ordered_scan(flagged, keys, order, chunk, sums={"__before": F.col("__new")}, fills={"__at": F.col("__start")})
    return out.select(*keys, "frame", *[c for c in targets.columns if c not in (*keys, "frame")],
                      (F.col("__before") + F.col("__new") - 1).cast("long").alias("run_id"),
                      X.div(F.col("__rn") - F.col("__at"), MAX_RUN).alias("chunk_id"))


def thumbnail_plan(items: DataFrame, sources: DataFrame, timelines: DataFrame | None = None, cached: DataFrame | None = None,
                   force: bool = False) -> DataFrame:
    """Work units: heavy sources one frame at a time, light ones in chunks of neighbouring frames.

    Targets of unknown sources are dropped. Returns (timeline_id where sources have one, source_id, media_class, run_id, chunk_id, first_frame,
    last_frame, n_frames); for heavy units run_id and chunk_id are null.
    """
    own = keyed("source_id", items, sources)
    kind = sources.select(*own, X.media_class("codec", "width", "height", F.col("hdr") if "hdr" in sources.columns else None).alias("media_class"))
    targets = materialize(thumbnail_targets(items, timelines, cached, force, own).join(kind, own))
    heavy = targets.where("media_class = 'heavy'").select(
        *own, "media_class", F.lit(None).cast("long").alias("run_id"), F.lit(None).cast("long").alias("chunk_id"),
        F.col("frame").alias("first_frame"), F.col("frame").alias("last_frame"), F.lit(1).cast("long").alias("n_frames"))
    light = frame_runs(targets.where("media_class = 'light'")).groupBy(*own, "media_class", "run_id", "chunk_id").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n_frames"))
    return heavy.unionByName(light)
