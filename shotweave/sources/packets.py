"""Packet timestamp tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shotweave.operators.ordered import chunk_of, row_index


def index_packets(packets: DataFrame, tie: list[str] | None = None, seconds: float = 64.0) -> DataFrame:
    """Number packets per source in pts order. ``tie`` makes the order total when pts repeat."""
    ordered = row_index(packets, ["source_id"], ["pts_time", *(tie or [])],
                        chunk_of("pts_time", seconds), "pts_ix")
    return ordered.select("source_id", "pts_ix", *[c for c in packets.columns if c not in ("source_id", *(tie or []))])


def write_packets(packets: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text tables of ``pts`` lines (source_id, pts), a folder per source; a long table is several files.

    Sources are dealt over all cores whatever their bytes, as a small file costs as much as a larger one. They are dealt in ranges of source and pts, so a
    source is in one file or two, and a very long one in many.
    """
    rows = packets.select("source_id", F.col("pts").cast("string").alias("pts"))
    rows.repartitionByRange(4 * packets.sparkSession.sparkContext.defaultParallelism, "source_id", "pts").write.mode(mode).partitionBy("source_id").text(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Text tables with one pts per line; blank and unparsable lines are skipped.

    The source id is that of the folder that ``write_packets`` made, or the file name without its extension.
    """
    written = F.regexp_extract(F.col("_metadata.file_path"), r"/source_id=([^/]+)/", 1)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.url_decode(F.when(written != "", written).otherwise(name)).alias("source_id"),
        F.regexp_replace(F.trim("value"), r",+$", "").try_cast("double").alias("pts_time"))
    return index_packets(lines.where(F.col("pts_time").isNotNull() & ~F.isnan("pts_time")))
