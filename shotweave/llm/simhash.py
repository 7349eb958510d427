"""SimHash near-duplicates found by a pigeonring filter (operator 9)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_digest

from ..session import materialize
from .common import map_texts
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Widths of the ring's segments, from the low bits up.
WIDTHS = (13, 13, 13, 13, 12)
#: Members up to which a bucket's pairs are compared one by one; a larger bucket is linked through shared neighbours instead.
PAIRWISE = 64

_M = len(WIDTHS)
_MASKS = [((1 << w) - 1) << sum(WIDTHS[:k]) for k, w in enumerate(WIDTHS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit fingerprint: a bit is set if over half of the shingles' hashes have it; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = xxh64_digest(joined, SEED)
    else:
        n = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(n + 1) - 1
        hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip((ends - n).tolist(), ends[SHINGLE - 1:].tolist(), strict=False)])
    total, count = np.zeros(64, np.int64), len(hashes) // 8
    raw = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for k in range(0, count, 1 << 16):
        total += np.unpackbits(raw[k:k + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    return map_texts(docs, lambda: lambda texts: {"fp": [fingerprint(t) for t in texts]}, ["doc_id"], "fp long")


def _ring(k: int, length: int) -> int:
    """Bits of ``length`` consecutive segments that start at segment ``k`` of the ring."""
    return sum(_MASKS[(k + j) % _M] for j in range(length))


def _at(position: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), position + 1)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` at ``DISTANCE`` or fewer differing bits, from distinct fingerprints.

    Pigeonring principle: if all segments together differ in at most D bits, then from some segment on, every chain of l
    consecutive segments of the M in the ring differs in at most l * D / M bits. For two bits and five segments, the chain's
    first two segments must be equal, so they are the bucket; chains of three and four may differ in one bit. Pairs that pass go
    to the full Hamming check. In a bucket of over ``PAIRWISE`` members, pairs would grow with the square, so each member is
    instead listed under itself and its one-bit changes outside the shared bits: two members lie within two bits if and only
    if they share such a neighbour, and no neighbour has more than 39 members. So no link is lost and no group is unbounded.
    """
    exact = max(n for n in range(1, _M + 1) if n * DISTANCE // _M == 0)
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(_ring(k, exact)))) for k in range(_M)))).alias("k", "part"))
    sizes = keyed.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(keyed.join(sizes, ["k", "part"]))
    small, large = met.where(F.col("n") <= PAIRWISE), met.where(F.col("n") > PAIRWISE)
    d = F.col("a").bitwiseXOR(F.col("b"))
    ok = F.bit_count(d) <= DISTANCE
    for n in range(exact + 1, _M):
        ok = (F.bit_count(d.bitwiseAND(_at(F.col("k"), [_signed(_ring(k, n)) for k in range(_M)]))) <= n * DISTANCE // _M) & ok
    pairs = (small.select("k", "part", F.col("fp").alias("a"))
             .join(small.select("k", "part", F.col("fp").alias("b")), ["k", "part"]).where(F.col("a") < F.col("b")).where(ok).select("a", "b"))
    rest = [F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << b)) for b in range(64) if not _ring(k, exact) >> b & 1)) for k in range(_M)]
    flips = F.lit(None).cast(T.ArrayType(T.LongType()))
    for k in range(_M):
        flips = F.when(F.col("k") == k, rest[k]).otherwise(flips)
    near = (large.select("fp", "k", "part", F.explode(flips).alias("flip"))
            .groupBy("k", "part", F.col("fp").bitwiseXOR(F.col("flip")).alias("near")).agg(F.sort_array(F.collect_list("fp")).alias("members"))
            .where(F.size("members") > 1))
    stars = near.select(F.element_at("members", 1).alias("a"), F.explode("members").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the least doc_id that links lead to, per document.

    Needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text has fingerprint zero and is linked like any other.
    Repeated rows stay rows of one component; a component with null ids only has a null ``component_id``. An empty table gives
    an empty result. Texts are never shuffled: the narrow fingerprint table is written once, equal fingerprints are one node from
    then on, and components are found on distinct fingerprints.
    """
    fps = materialize(fingerprints(docs))
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialize(components(links(least.select("fp"))).withColumnRenamed("node", "fp"))
    linked = least.join(roots, "fp")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "root").select("fp", "component_id")
    # a document alone on its fingerprint needs no lookup beyond its own group's least id
    nodes = least.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(nodes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
