"""Crop export jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from shotweave.functions import expr as X
from shotweave.operators.crops import active_segments, native_dims, window_geometry
from shotweave.operators.joins import route_crops
from shotweave.operators.ordered import keyed
from shotweave.operators.timeline import TL, filter_crops, is_gap
from shotweave.session import materialize


@dataclass(frozen=True)
class CropOptions:
    group_ids: Sequence | None = None
    include_untagged: bool = False
    out_mode: str = "master"  # or "native"
    out_width: int = 0
    root_dir: str = ""
    extension: str = ".mp4"


def _with_clip_source(crops: DataFrame, items: DataFrame) -> DataFrame:
    real = items.where(~is_gap()).select(TL, "clip_id", F.col("source_id").alias("__sid"))
    return crops.drop("source_id", "source_in", "source_out").join(real, [TL, "clip_id"]).withColumnRenamed("__sid", "source_id")


def _label(col_label: str = "label", col_id: str = "crop_id"):
    clean = F.trim(F.coalesce(col_label, F.lit("")))
    return F.when(clean != "", clean).otherwise(F.concat(F.lit("crop "), F.left(F.col(col_id).cast("string"), F.lit(6))))


def _windows(crops, segments, items, sources, opts: CropOptions, default_fps: float | None):
    c = filter_crops(_with_clip_source(crops, items), opts.group_ids, opts.include_untagged)
    source = keyed("source_id", sources, c)
    src = sources.select(*source, "file_path", "fps", "audio_channels", F.lit(True).alias("__found"))
    c = c.join(src, source, "left")
    c = c.withColumn("fps", F.coalesce("fps", F.lit(default_fps))) if default_fps else c.where("__found")
    # both feed several branches of the geometry
    c = materialize(c)
    return c, materialize(active_segments(c, segments))


def crop_jobs(crops: DataFrame, segments: DataFrame, keyframes: DataFrame, items: DataFrame, sources: DataFrame, groups: DataFrame,
              opts: CropOptions = CropOptions(), folders: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One job per active window of an active, matching crop whose ratio stays constant; and the skipped crops.

    The folder is ``folders`` by tag (null is its own bucket, crops without a folder drop out), else a
    sub-folder of ``root_dir`` named after the tag.
    """
    c, windows = _windows(crops, segments, items, sources, opts, None)
    if folders is not None:
        c = route_crops(c, folders)
    else:
        group = keyed("group_id", groups, c)
        g = groups.select(*group, F.col("name").alias("__gname"))
        c = c.join(g, group, "left").withColumn(
            "folder", F.concat(F.lit(opts.root_dir.rstrip("/") + "/"), X.folder_slug("__gname")))
        if not opts.root_dir:
            c = c.where(F.lit(False))
    windows = windows.join(c.select(TL, "crop_id", "folder"), [TL, "crop_id"])
    geo = native_dims(window_geometry(windows, c, keyframes))
    j = windows.join(geo.select(TL, "crop_id", "segment_id", "animated", "anchor_w", "anchor_h", "base_w", "base_h", "native_w", "native_h",
                                "aspect_constant"), [TL, "crop_id", "segment_id"])
    if opts.out_mode == "native":
        dims = F.struct(F.col("native_w").alias("out_w"), F.col("native_h").alias("out_h"))
    else:
        width = F.lit(opts.out_width).cast("long") if opts.out_width > 0 else F.col("anchor_w")
        dims = X.crop_output_dims("anchor_w", "anchor_h", "base_w", "base_h", width)
    good = j.where("aspect_constant").withColumn("__d", dims)
    name = X.crop_job_name(X.stem("file_path"), "anchor_frame", "__d.out_w", "__d.out_h", "crop_id", "segment_id")
    jobs = good.select(
        TL, "clip_id", "crop_id", "segment_id", "anchor_frame", "source_id", F.col("file_path").alias("source_path"), "fps",
        F.col("__d.out_w").alias("out_w"), F.col("__d.out_h").alias("out_h"), "animated",
        F.coalesce(F.col("audio_channels") > 0, F.lit(False)).alias("has_audio"), "folder", name.alias("name"),
        F.concat("folder", F.lit("/"), name, F.lit(opts.extension)).alias("out_path"))
    skipped = j.where(~F.col("aspect_constant")).select(TL, _label().alias("label")).distinct()
    return jobs, skipped


def crop_summary(crops, segments, keyframes, items, sources, opts: CropOptions = CropOptions()) -> DataFrame:
    """Per timeline: exportable windows and crops with a blocked window. A missing source counts as 24 fps here."""
    c, windows = _windows(crops, segments, items, sources, opts, 24.0)
    geo = window_geometry(windows, c, keyframes)
    per_crop = geo.groupBy(TL, "crop_id").agg(
        F.count_if("aspect_constant").alias("n"), F.bool_or(~F.col("aspect_constant")).alias("blocked"))
    return per_crop.groupBy(TL).agg(F.sum("n").alias("n_exportable"), F.count_if("blocked").alias("n_blocked"))


def blocked_labels(crops, segments, keyframes, items, sources, opts: CropOptions = CropOptions()) -> DataFrame:
    c, windows = _windows(crops, segments, items, sources, opts, 24.0)
    geo = window_geometry(windows, c, keyframes).where(~F.col("aspect_constant")).select(TL, "crop_id").distinct()
    return c.join(geo, [TL, "crop_id"], "left_semi").select(TL, _label().alias("label")).distinct()
