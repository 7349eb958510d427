"""Snapshot versions: reconciliation with the directory, listing order, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shotweave.functions import expr as X

# ---- fixed values --------------------------------------------------------------------
KEEP_NEWEST = 50
HOURLY_DAYS = 1
DAILY_DAYS = 7


def version_time(text: Column) -> Column:
    """Timestamp of a manifest entry; unreadable text counts as the epoch."""
    parsed = F.try_to_timestamp(text).cast("timestamp_ntz")
    return F.coalesce(parsed, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def reconcile_versions(manifest: DataFrame, files: DataFrame, keys: list[str] | None = None, extension: str = "project") -> DataFrame:
    """Manifest entries that still have a file, plus files without an entry, described by their name.

    ``files``: filename, size_bytes and, when known, clip_count / source_count. Unparsable orphan names
    are dropped.
    """
    keys = keys or []
    for c in ("clip_count", "source_count"):
        if c not in files.columns:
            files = files.withColumn(c, F.lit(0).cast("long"))
    m = manifest.select(*keys, "filename", F.struct("timestamp", "trigger", "label", "clip_count", "source_count", "size_bytes").alias("m"))
    d = files.select(*keys, "filename", F.col("clip_count").alias("d_clips"), F.col("source_count").alias("d_sources"),
                     F.col("size_bytes").alias("d_size"), F.lit(True).alias("__disk"))
    both = m.join(d, [*keys, "filename"], "full_outer").where("__disk")
    name = X.parse_version_name("filename", extension)
    both = both.withColumn("__p", name).where(F.col("m").isNotNull() | F.col("__p.matched"))
    derived = F.struct(
        F.date_format("__p.ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("__p.trigger").alias("trigger"),
        F.col("__p.label").alias("label"), F.coalesce("d_clips", F.lit(0)).cast("long").alias("clip_count"),
        F.coalesce("d_sources", F.lit(0)).cast("long").alias("source_count"),
        F.coalesce("d_size", F.lit(0)).cast("long").alias("size_bytes"))
    pick = F.when(F.col("m").isNotNull(), F.struct(*[F.col(f"m.{c}").alias(c) for c in (
        "timestamp", "trigger", "label")], *[F.col(f"m.{c}").cast("long").alias(c) for c in (
            "clip_count", "source_count", "size_bytes")])).otherwise(derived)
    return both.select(*keys, "filename", pick.alias("e"), F.col("m").isNull().alias("derived")).select(
        *keys, "filename", "e.*", "derived")


def newest_versions(versions: DataFrame, n: int = KEEP_NEWEST, key: str = "project_id") -> DataFrame:
    """The n newest per project. The rank filter is pushed below the shuffle, so a project with very
    many versions sends only n rows per map task."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("filename").desc())
    return versions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def retention_bucket(ts: Column, now: Column) -> Column:
    """Hour, day or ISO-week bucket by age."""
    iso_week = F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-"),
                        F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return (F.when(ts >= now - F.expr(f"interval {HOURLY_DAYS} day"), F.concat(F.lit("h"), F.date_format(ts, "yyyy-MM-dd_HH")))
            .when(ts >= now - F.expr(f"interval {DAILY_DAYS} day"), F.concat(F.lit("d"), F.date_format(ts, "yyyy-MM-dd")))
            .otherwise(F.concat(F.lit("w"), iso_week)))


def retain_versions(versions: DataFrame, now: Column, key: str = "project_id") -> DataFrame:
    """Kept versions with the reason: the newest 50, then the newest per bucket among the older ones.

    The 50th version is a per-project cut line; everything below it is a max-by aggregation, so no
    project is ever sorted whole.
    """
    top = newest_versions(versions, KEEP_NEWEST, key)
    line = top.groupBy(key).agg(F.min(F.struct("ts", "filename")).alias("__line"))
    old = versions.join(line, key).where(F.struct("ts", "filename") < F.col("__line"))
    old = old.withColumn("__bucket", retention_bucket(F.col("ts"), now))
    rest = [c for c in versions.columns if c != key]
    best = old.groupBy(key, "__bucket").agg(F.max_by(F.struct(*rest), F.struct("ts", "filename")).alias("r"))
    kept = best.select(key, "r.*", F.col("__bucket").alias("reason"))
    return top.select(*versions.columns, F.lit("newest").alias("reason")).unionByName(kept.select(*versions.columns, "reason"))
