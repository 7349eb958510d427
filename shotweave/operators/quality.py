"""Measurements on packets, frames, files and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shotweave.functions import expr as X
from shotweave.operators.detect import pixel_diff, vector_diff
from shotweave.operators.ordered import chunk_of, ordered_scan
from shotweave.operators.timeline import TL

PTS_SECONDS = 64.0  # chunk width along presentation time


def pts_jitter(packets: DataFrame, sources: DataFrame) -> DataFrame:
    """Smallest and largest pts step per source against the nominal one, and three warning flags.

    ``sources``: source_id, fps, total_frames and, when known, nb_frames and start_time.
    """
    for c, t in (("nb_frames", "long"), ("start_time", "double")):
        if c not in sources.columns:
            sources = sources.withColumn(c, F.lit(None).cast(t))
    steps = ordered_scan(packets.select("source_id", "pts_time", "pts_ix"), ["source_id"], ["pts_time", "pts_ix"],
                         chunk_of("pts_time", PTS_SECONDS), prev={"__p": F.col("pts_time")})
    gap = F.col("pts_time") - F.col("__p")
    agg = steps.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_packets"), F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap"))
    out = agg.join(sources.select("source_id", "fps", "total_frames", "nb_frames", "start_time"), "source_id")
    nominal = 1.0 / F.col("fps")
    return out.select(
        "source_id", "n_packets", "min_gap", "max_gap", nominal.alias("nominal_gap"),
        F.coalesce(F.col("max_gap") > 1.5 * nominal, F.lit(False)).alias("irregular"),
        F.coalesce((F.col("nb_frames") != 0) & (F.col("nb_frames") != F.col("total_frames")), F.lit(False)).alias("count_mismatch"),
        F.coalesce(F.col("start_time") > 1e-6, F.lit(False)).alias("late_start"))


def gop_stats(packets: DataFrame) -> DataFrame:
    """Key-frame count and spacing per source; sources with fewer than two key frames have no row."""
    i = packets.where("pict_type = 'I'").select("source_id", "pts_time", "pts_ix")
    steps = ordered_scan(i, ["source_id"], ["pts_time", "pts_ix"], chunk_of("pts_time", PTS_SECONDS), prev={"__p": F.col("pts_time")})
    gap = F.col("pts_time") - F.col("__p")
    agg = steps.groupBy("source_id").agg(F.count(F.lit(1)).alias("i_frames"), F.avg(gap).alias("avg_sec"), F.max(gap).alias("max_sec"))
    return agg.where("avg_sec is not null").withColumn("avg_frames", F.col("avg_sec") * 24.0)


def cache_inventory(files: DataFrame) -> DataFrame:
    """Files and bytes per category, and the grand total as category null."""
    return files.rollup("category").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("n_bytes"))


def duplicate_summary(frames: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(per source: frames, distinct images, adjacent repeats, first hash; one row per repeated frame)."""
    h = frames.select("source_id", "frame_ix", F.md5(F.col(payload).cast("binary")).alias("hash"))
    flagged = ordered_scan(h, ["source_id"], ["frame_ix"], chunk_of("frame_ix"), prev={"__p": F.col("hash")})
    repeats = flagged.where(F.col("hash") == F.col("__p")).select("source_id", "frame_ix", "hash")
    # distinct counting through one row per (source, hash): a huge source is spread over its hashes
    per_hash = h.groupBy("source_id", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("frame_ix").alias("first_ix"))
    base = per_hash.groupBy("source_id").agg(
        F.sum("n").alias("n_frames"), F.count(F.lit(1)).alias("n_unique"), F.min_by("hash", "first_ix").alias("first_hash"))
    dup = repeats.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_repeats"))
    summary = base.join(dup, "source_id", "left").withColumn("n_repeats", F.coalesce("n_repeats", F.lit(0)))
    return summary, repeats


def same_first_frame(summary: DataFrame) -> DataFrame:
    """Outputs that begin with the same image: every output with the size of its group."""
    n = summary.groupBy("first_hash").agg(F.count(F.lit(1)).alias("n_outputs"))
    return summary.select("source_id", "first_hash").join(n, "first_hash")


def cfr_check(packets: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Constant frame rate verdict per source: one packet duration passes, two with a differing tail warn,
    anything else fails. ``rates`` (r_rate, avg_rate as numbers) adds the 0.1% comparison."""
    g = packets.groupBy("source_id", "duration").agg(
        F.count(F.lit(1)).alias("n"), F.min("pts_ix").alias("lo"), F.max("pts_ix").alias("hi"))
    s = g.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_durations"), F.sum("n").alias("n_packets"),
        F.min_by("duration", "lo").alias("first_duration"), F.max_by("duration", "hi").alias("last_duration"))
    verdict = (F.when(F.col("n_durations") == 1, "pass")
               .when((F.col("n_durations") == 2) & (F.col("first_duration") != F.col("last_duration")), "warn").otherwise("fail"))
    s = s.withColumn("verdict", verdict)
    if rates is None:
        return s
    near = F.abs(F.col("r_rate") - F.col("avg_rate")) / F.greatest(F.col("r_rate"), F.lit(1e-6)) < 0.001
    return s.join(rates.select("source_id", near.alias("rates_agree")), "source_id", "left")


def audio_drift(plan: DataFrame, actual: DataFrame, rate: int = X.AUDIO_RATE) -> DataFrame:
    """Expected against actual audio samples and video frames per timeline (actual: samples, video_frames)."""
    exp = plan.groupBy(TL).agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("frame_count").alias("expected_frames"),
        F.sum(X.exact_samples("frame_count", "fps", rate)).alias("expected_samples"))
    drift = F.col("samples") - F.col("expected_samples")
    ms = drift / F.lit(rate / 1000.0)
    return exp.join(actual.select(TL, "samples", "video_frames"), TL).select(
        TL, "n_segments", "expected_samples", drift.alias("drift_samples"), ms.alias("drift_ms"),
        (ms / F.greatest(F.col("n_segments"), F.lit(1))).alias("ms_per_segment"),
        (F.col("video_frames") - F.col("expected_frames")).alias("frame_drift"), (F.abs(ms) < 1.0).alias("passed"))


def brightness_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paired luma comparison per output (output_id, frame_ix, luma; ``before`` also is_hdr).

    High-dynamic-range outputs must get more than 30 brighter on average, others must stay within 5.
    """
    p = before.select("output_id", "frame_ix", "is_hdr", F.col("luma").alias("a")).join(
        after.select("output_id", "frame_ix", F.col("luma").alias("b")), ["output_id", "frame_ix"])
    d = F.col("b") - F.col("a")
    s = p.groupBy("output_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.bool_or("is_hdr").alias("is_hdr"), F.avg("a").alias("mean_before"),
        F.avg("b").alias("mean_after"), F.avg(d).alias("mean_delta"), F.max(F.abs(d)).alias("max_abs_delta"))
    ok = F.when(F.col("is_hdr"), F.col("mean_after") - F.col("mean_before") > 30.0).otherwise(F.col("max_abs_delta") < 5.0)
    return s.withColumn("passed", ok)


def alignment_offset(out: DataFrame, ref: DataFrame, kind: str = "scalar", offsets: tuple[int, ...] = (0, -1, 1, 2)) -> DataFrame:
    """Which neighbour of the intended source frame an output frame shows: the offset with the least mean
    difference, earlier listed offsets first on ties. ``out``: output_id, source_id, frame_ix, feature."""
    steps = F.array(*[F.struct(F.lit(o).alias("off"), F.lit(i).alias("rank")) for i, o in enumerate(offsets)])
    probe = out.select("output_id", "source_id", "frame_ix", F.col("feature").alias("__o"), F.explode(steps).alias("s"))
    probe = probe.select("output_id", "source_id", "frame_ix", "__o", "s.*", (F.col("frame_ix") + F.col("s.off")).alias("__f"))
    hit = probe.join(ref.select("source_id", F.col("frame_ix").alias("__f"), F.col("feature").alias("__r")), ["source_id", "__f"])
    a, b = F.col("__o"), F.col("__r")
    diff = F.abs(a - b) if kind == "scalar" else vector_diff(a, b) if kind == "vector" else pixel_diff(a, b)
    hit = hit.withColumn("diff", diff)
    best = hit.groupBy("output_id", "source_id", "frame_ix").agg(
        F.min_by("off", F.struct("diff", "rank")).alias("best_offset"), F.min("diff").alias("best_diff"),
        F.max(F.when(F.col("off") == 0, F.col("diff"))).alias("diff_at_zero"))
    return best.where("diff_at_zero is not null").withColumn("aligned", F.col("best_offset") == 0)


def first_mismatches(rows: DataFrame, keys: list[str], order: list[str], n: int = 10) -> DataFrame:
    """Report rows: the first n mismatches per key (a top-k report) and how many more there are.

    The rank filter is pushed below the shuffle; the remainder is a separate count.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    total = rows.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("n_more"))
    return top.join(total, keys)
