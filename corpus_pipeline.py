"""A training-data pipeline over ``documents``: the stages in order, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.bpe import encode_documents
from shotweave.llm.common import table
from shotweave.llm.decontaminate import benchmark_hits
from shotweave.llm.pii import redact
from shotweave.llm.quality_model import classify
from shotweave.llm.similar import similar_groups
from shotweave.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rows(docs: DataFrame) -> DataFrame:
    """The id next to the whole row, so that columns of any name pass through the operators."""
    return docs.select("doc_id", F.struct(*docs.columns).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this stage's labelled documents, predicts to be good.

    Null, empty and very long texts are scored like any other, repeated rows alike; an empty table gives an empty result.
    """
    return classify(_rows(docs), table(spark, sf_dir, "labels"), ["row"], "row.text").where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of five-word shingles of 0.8 or more, and chains of such pairs).

    It is the one with the least id; documents without an id come after all others of their group. Of repeated rows with
    that id and text, one is kept.
    """
    key = F.coalesce("doc_id", F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))).alias("key")
    found = similar_groups(docs.select(key, F.xxhash64("text").alias("hash"), "text"))
    first = found.select(F.col("first_key").alias("key"), F.col("first_hash").alias("hash")).distinct()
    rows = docs.select(key, F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("row"))
    return rows.join(first, ["key", "hash"], "left_semi").dropDuplicates(["key", "hash"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any full window of ten benchmark words.

    Items of fewer words are left to op4's report: a one-word answer must not remove every document with that word. Null and empty texts have no words
    and stay, very long ones are judged whole, repeated rows alike; an empty table or an empty benchmark removes nothing.
    """
    key = F.xxhash64("text").alias("key")
    hits = benchmark_hits(docs.select("doc_id", "text", key), table(spark, sf_dir, "benchmark"), ["key"], short_items=False)
    bad = hits.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    rows = docs.select("doc_id", key, F.struct(*docs.columns).alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key"))
    return rows.join(bad, same, "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids and the digest of their decoding, with its language and source.

    A null text is empty and has no ids; very long texts are encoded in parts, repeated rows alike; an empty table gives an empty result.
    """
    coded = encode_documents(docs, ["doc_id", "lang", "source"], decode=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality), ("near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("PII", personal_data),
    ("BPE encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages train models, hash with XXH64 and cluster; SQL cannot express them.
ORACLE_SQL: str | None = None
PIPELINE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {"pipeline": (run, ORACLE_SQL)}
