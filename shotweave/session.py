"""Session helpers: one place for the settings the operators rely on."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def build_session(app: str = "shotweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a single machine."""
    named = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
             or spark.sparkContext.getCheckpointDir())
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each write ends, not when the driver's memory happens to be collected."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextlib.contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Files of very many small folders are listed by a few tasks a core; by default each folder would be a task of its own."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` stores inside are deleted at the end; for work whose result is itself written inside."""
    outer, mine = _scratch.get(), []
    token = _scratch.set(mine)
    try:
        yield
        for path in mine:
            drop_folder(spark, path)
        mine.clear()
    finally:
        _scratch.reset(token)
        if outer is not None:
            outer.extend(mine)


def materialize_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` builds, stored; the tables that it stores on its way are deleted."""
    outer = _scratch.get()
    with scratch(SparkSession.active()):
        df = make()
        token = _scratch.set(outer)
        try:
            return materialize(df)
        finally:
            _scratch.reset(token)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where a result that already cost shuffles feeds several consumers (an ordered scan reads its
    input twice): the upstream plan runs once, consumers read only the columns they need, and a lost
    executor costs a re-read instead of a recomputation. Zstandard, as these tables are read once or twice and fill
    the shared folder. The shuffles that led to it are not kept.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/shotweave/{uuid.uuid4().hex}"
    if (stored := _scratch.get()) is not None:
        stored.append(path)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
