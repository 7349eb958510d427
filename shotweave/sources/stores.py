"""Frame stores, version folders and job manifests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shotweave import schema as S
from shotweave.functions import expr as X
from shotweave.operators.versions import reconcile_versions, version_time
from shotweave.session import materialize
from shotweave.sources.files import RANGE_BYTES, read_flat_records, write_files
from shotweave.sources.projects import count_documents

FRAME_BYTES = 48 * 27 * 3


def read_frame_store(spark: SparkSession, path: str, offsets: DataFrame | None = None, frame_bytes: int = FRAME_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fixed-size records of flat binary files as rows (source_id, frame_ix, pixels).

    The source id is the file name without its extension; ``offsets`` (source_id, frame_offset) shifts the
    numbers, 0 when absent. A trailing partial record is ignored. A file is read in ranges of records by many tasks, whatever its length.
    """
    f = read_flat_records(spark, path, frame_bytes, "*.bin", range_bytes).select(
        F.regexp_extract("path", r"([^/]+?)\.bin$", 1).alias("source_id"), F.col("record_ix").alias("i"), F.col("record").alias("pixels"))
    if offsets is None:
        return f.select("source_id", F.col("i").alias("frame_ix"), "pixels")
    return f.join(offsets, "source_id", "left").select(
        "source_id", (F.col("i") + F.coalesce("frame_offset", F.lit(0))).alias("frame_ix"), "pixels")


def write_flat_store(frames: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, records: int = 4096) -> DataFrame:
    """Flat files of at most ``records`` frames each, ``<source>-<part>.bin``; returns the offsets (source_id, file_id, frame_offset) of what was written.

    A file holds a run of numbers from its offset on; numbers that are not there are filled with zeros, as the format has no holes. A source of any
    length is many bounded groups. Frames of another size are an error.
    """
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        first = key[1].as_py() * records
        at = [n - first for n in group["frame_ix"].to_pylist()]
        out = bytearray((max(at) + 1) * frame_bytes)
        for k, v in zip(at, group["pixels"].to_pylist(), strict=True):
            if len(v) != frame_bytes:
                raise ValueError(f"frame {first + k} of {key[0].as_py()} has {len(v)} bytes instead of {frame_bytes}")
            out[k * frame_bytes:(k + 1) * frame_bytes] = v
        return pa.table([[f"{key[0].as_py()}-{key[1].as_py()}.bin"], [bytes(out)]], schema=schema)

    rows = frames.select(F.col("source_id").cast("string").alias("source_id"), F.floor(F.col("frame_ix") / records).cast("long").alias("part"), "frame_ix", "pixels")
    # by number, not by bytes: what a small file costs is its creation
    rows = rows.repartition(4 * frames.sparkSession.sparkContext.defaultParallelism, "source_id", "part")
    files = materialize(write_files(rows.groupBy("source_id", "part").applyInArrow(pack, "path string, content binary"), path))
    name = F.regexp_extract("path", r"^(.*)-(\d+)\.bin$", 1)
    part = F.regexp_extract("path", r"^(.*)-(\d+)\.bin$", 2).cast("long")
    return files.select(name.alias("source_id"), F.regexp_replace("path", r"\.bin$", "").alias("file_id"), (part * records).alias("frame_offset"))


def get_frames(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Frames by number; numbers outside the store give null pixels."""
    return wanted.join(store, ["source_id", "frame_ix"], "left")


def write_frame_store(frames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet in the order of source and frame number, so that sources and ranges prune by the statistics of files and row groups.

    No folder per source: very many short sources would cost a file each. Range partitioning includes the frame number: a huge source spreads over many tasks.
    """
    (frames.repartitionByRange("source_id", "frame_ix").sortWithinPartitions("source_id", "frame_ix")
     .write.mode(mode).parquet(path))


def read_versions(spark: SparkSession, path: str, extension: str = "project") -> DataFrame:
    """Versions of a snapshot folder, or of many (a path pattern): the manifest reconciled with the files, newest time as ``ts``.

    ``folder`` tells the folders apart, so equal file names of two projects do not meet. A folder without a manifest, or without snapshots, is
    read like any other.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(path)
             .select(*_folder_and_name("path"), F.col("length").alias("size_bytes")))
    counts = count_documents(spark.read.option("pathGlobFilter", f"*.{extension}").text(path, wholetext=True)
                             .select(*_folder_and_name(F.col("_metadata.file_path")), F.col("value").alias("text")), ["folder", "filename"])
    doc = "versions array<struct<filename:string,timestamp:string,trigger:string,label:string,clip_count:bigint,source_count:bigint,size_bytes:bigint>>"
    # by name pattern, so that a folder without a manifest reads as one without entries
    m = (spark.read.option("pathGlobFilter", "index.json").text(path, wholetext=True)
         .select(_folder_and_name(F.col("_metadata.file_path"))[0], F.explode(F.from_json("value", doc)["versions"]).alias("v")))
    zero = F.lit(0).cast("long")
    manifest = m.where("v.filename is not null and v.timestamp is not null").select(
        "folder", "v.filename", "v.timestamp", F.coalesce("v.trigger", F.lit("manual")).alias("trigger"), "v.label",
        *[F.coalesce(f"v.{c}", zero).alias(c) for c in ("clip_count", "source_count", "size_bytes")])
    out = reconcile_versions(manifest, files.join(counts, ["folder", "filename"], "left"), ["folder"], extension=extension)
    return out.withColumn("ts", version_time(F.col("timestamp")))


def _folder_and_name(path) -> tuple:
    """Folder and name of a file; the writing of local paths differs between Spark's readers, so the scheme's slashes are brought to one form."""
    path = F.regexp_replace(path, "^file:/*", "/")
    return F.url_decode(F.regexp_extract(path, r"^(.*)/[^/]+$", 1)).alias("folder"), F.url_decode(F.regexp_extract(path, r"([^/]+)$", 1)).alias("filename")


def write_crop_manifest(jobs: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "json") -> None:
    """Job manifest routed to a folder per tag. No shuffle by tag: a popular one is written by many tasks."""
    slug = F.regexp_extract("folder", r"([^/]+)$", 1)
    jobs.withColumn("group_slug", slug).write.mode(mode).format(fmt).partitionBy("group_slug").save(path)
