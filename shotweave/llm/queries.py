"""The registered queries of the subpackage, over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip
from .common import scratch, table
from .decontaminate import benchmark_hits
from .fim import fill_in_middle
from .fim import oracle_sql as fim_sql
from .neighbours import nearest
from .neighbours import oracle_sql as nearest_sql
from .pii import find_personal_data
from .quality_model import classify
from .quality_rules import quality_rules
from .repeats import periodic_runs
from .secrets import oracle_sql as secrets_sql
from .secrets import scan_secrets
from .sharding import assign_shards
from .simhash import near_duplicates
from .token_files import read_token_files, write_token_files
from .warc import read_archives, write_archives


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), target)
    return read_token_files(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), target)
    return read_archives(spark, target, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), ["doc_id"])


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), collapsed=False)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), texts=False)


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_sharding": (op1_sharding, None),
    "op2_secret_scan": (op2_secret_scan, secrets_sql()),
    "op3_token_files": (op3_token_files, None),
    "op4_winnowing_decontamination": (op4_winnowing_decontamination, None),
    "op5_warc": (op5_warc, None),
    "op6_bpe_round_trip": (op6_bpe_round_trip, None),
    "op7_personal_data": (op7_personal_data, None),
    "op8_quality_classifier": (op8_quality_classifier, None),
    "op9_simhash_near_dedup": (op9_simhash_near_dedup, None),
    "op10_quality_rules": (op10_quality_rules, None),
    "op11_nearest_neighbours": (op11_nearest_neighbours, nearest_sql()),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_fill_in_middle": (op13_fill_in_middle, fim_sql()),
}
