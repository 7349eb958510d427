"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import shared_dir

#: Text bytes that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


#: Bytes of the Arrow batches between the JVM and Python; Spark's own bound would let a task hold several buffers of 64 MiB.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of Arrow batches to ``BATCH_BYTES``, as texts may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) != str(BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's name below the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/shotweave/{kind}-{uuid.uuid4().hex}"


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batches, each with its texts as UTF-8 bytes (None for null) and at most ``limit`` bytes of text or one row.

    ``column`` may name a field of a struct column, as ``row.text``.
    """
    name, _, field = column.partition(".")
    for batch in batches:
        values = batch.column(name).field(field) if field else batch.column(name)
        values = values.cast(pa.binary())
        first, size = 0, 0
        for i in range(len(values)):
            n = len(values[i].as_buffer()) if values[i].is_valid else 0
            if i > first and size + n > limit:
                yield batch.slice(first, i - first), values.slice(first, i - first).to_pylist()
                first, size = i, 0
            size += n
        if len(values) > first:
            yield batch.slice(first), values.slice(first).to_pylist()


def map_texts(df: DataFrame, factory, keep: list[str], schema: str, limit: int = SLICE_BYTES, text: str = "text", with_keys: str | None = None) -> DataFrame:
    """``keep`` columns and the columns of ``schema``, made from the texts in Arrow batches without a shuffle.

    ``factory`` is called once per task, so that its result may hold compressors or caches; that is called with lists of texts and returns a dict
    of lists or Arrow arrays. ``with_keys`` names a column whose values are handed on as a second list. Rows that have to carry columns of any name go in a struct column, whose field ``text`` may name.
    """
    small_batches(df.sparkSession)
    names = list(dict.fromkeys([*keep, text.partition(".")[0], *([with_keys] if with_keys else [])]))
    out = T.StructType([df.schema[k] for k in keep] + T.StructType.fromDDL(schema).fields)

    def run(batches):
        work = factory()
        for batch, texts in slices(batches, text, limit):
            made = work(texts, batch.column(with_keys).to_pylist()) if with_keys else work(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(v if isinstance(v, pa.Array) else pa.array(v) for v in made.values())],
                                             [*keep, *made])
            pa.default_memory_pool().release_unused()

    return df.select(*names).mapInArrow(run, out)
