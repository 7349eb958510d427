"""Near-duplicates by exact Jaccard similarity of word shingles; SimHash links (op9) and banded MinHash propose the pairs (the pipeline's dedup stage)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from ..session import materialize
from .common import map_texts
from .components import components
from .simhash import fingerprint, links

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: A pair of similarity s shares none of the bands with probability (1 - s ** ROWS) ** BANDS: 1.3e-7 at 0.8, less above.
ROWS, BANDS, SEED = 5, 40, 42
#: Bound of the frequent shingles whose counts are sent to all tasks: 16 MiB.
FREQUENT = 1 << 20
#: Members up to which all pairs of a band's bucket are compared.
PAIRWISE = 32

_RND = np.random.default_rng(SEED)
_MUL = _RND.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RND.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; a shorter text is one run, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    first = ends - n
    hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(first.tolist(), ends[min(width, len(words)) - 1:].tolist(), strict=False)])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """One signed hash per band of the set's minima; of an empty set, none."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 2048):
        np.minimum(least, (found[k:k + 2048, None] * _MUL + _ADD).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.frombuffer(b"".join([xxh64_digest(r.tobytes(), k) for k, r in enumerate(rows)]), "<i8").tolist()


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def _signatures(texts: list) -> dict:
    sets = [shingles(t) for t in texts]
    return {"node": [_node(s) for s in sets], "n": [len(s) for s in sets], "bands": pa.array([bands(s) for s in sets], pa.list_(pa.int64())), "fp": [fingerprint(t) for t in texts]}


def _sets(texts: list) -> dict:
    return {"set": pa.array([shingles(t).astype(np.int64) for t in texts], pa.list_(pa.int64()))}


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sets reach the similarity."""
    p, q = LEAST
    one, two = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    found = pairs.join(one, "a").join(two, "b")
    return found.where(q * both >= p * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _close(a: str, b: str) -> Column:
    """Whether sets of these sizes can reach the similarity at all."""
    p, q = LEAST
    return (q * F.col(a) >= p * F.col(b)) & (q * F.col(b) >= p * F.col(a))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs by SimHash, as op9 links them: each node with its fingerprint's least node, and the least nodes of linked fingerprints."""
    heads = materialize(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head")))
    one, two = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab")
    near = links(heads.select("fp")).join(one, "a").join(two, "b").select("head_a", "head_b")
    same = nodes.join(heads, "fp").select(F.struct("node", "n").alias("head_a"), F.col("head").alias("head_b")).where("head_a.node <> head_b.node")
    met = near.union(same).select(F.col("head_a.node").alias("x"), F.col("head_a.n").alias("n_x"), F.col("head_b.node").alias("y"), F.col("head_b.n").alias("n_y"))
    return met.where(_close("n_x", "n_y")).select("x", "y")


def _buckets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of the small buckets, and (part, node, n) of the members of the large ones.

    At most one row more than ``PAIRWISE`` of a bucket leaves a task, so a bucket that holds very many rows is never gathered.
    """
    keyed = nodes.select("node", "n", F.explode("bands").alias("part"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("n", "node"))
    firsts = keyed.withColumn("rank", rank).where(F.col("rank") <= PAIRWISE + 1)
    parts = materialize(firsts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("n", "node"))).alias("members")).where("size(members) > 1"))
    small = parts.where(F.size("members") <= PAIRWISE)
    one = small.select("members", F.posexplode("members").alias("at", "one"))
    two = one.select(F.col("one.node").alias("x"), F.col("one.n").alias("n_x"),
                     F.explode(F.slice("members", F.col("at") + 2, PAIRWISE)).alias("two"))
    pairs = two.select("x", "n_x", F.col("two.node").alias("y"), F.col("two.n").alias("n_y")).where(_close("n_x", "n_y")).select("x", "y")
    large = parts.where(F.size("members") > PAIRWISE).select("part")
    return pairs, keyed.join(large, "part", "left_semi")


def _stars(crowd: DataFrame) -> DataFrame:
    """Pairs of each member of a large bucket with the bucket's head: the member that is in most large buckets, hence nearest to its middle."""
    often = crowd.groupBy("node").agg(F.count(F.lit(1)).alias("often"))
    heads = crowd.join(often, "node").groupBy("part").agg(F.max_by(F.struct("node", "n"), F.struct("often", "node")).alias("head"))
    met = crowd.join(heads, "part").select(F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("head.node").alias("y"), F.col("head.n").alias("n_y"))
    return met.where("x <> y").where(_close("n_x", "n_y")).select("x", "y")


def _apart(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root, odd) of the members of large buckets; odd: in one of them, the node is outside the bucket's main group."""
    placed = materialize(crowd.join(roots, "node", "left").select("part", "node", "n", F.coalesce("root", "node").alias("root")))
    main = (placed.groupBy("part", "root").agg(F.count(F.lit(1)).alias("rows")).groupBy("part")
            .agg(F.max_by("root", F.struct("rows", "root")).alias("main")))
    odd = placed.join(main, "part").where("root <> main").select("node").distinct().withColumn("odd", F.lit(True))
    return placed.select("node", "root").distinct().join(odd, "node", "left").select("node", "root", F.coalesce("odd", F.lit(False)).alias("odd"))


def _by_prefix(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of different groups, one of them odd, that may reach the similarity: an exact prefix filter.

    Order all shingles by the number of members that have them, rarest first (any one order of all shingles is exact, this one meets the fewest). Two sets of m and n shingles with a similarity of t or more
    share t / (1 + t) * (m + n) of them, so they share one among the first m - t * m + 1 of the one and the first n - t * n + 1 of the other, and
    at places that leave enough shingles behind. What is odd in its bucket has many shingles of its own, which come first: it meets nearly
    nobody, however large the bucket is and however many documents share a passage.
    """
    p, q = LEAST
    own = members.join(sets, "node").select("node", "root", "odd", "set")
    counts = materialize(own.select(F.explode("set").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    least = max(1, (counts.agg(F.sum("times")).first()[0] or 0) // FREQUENT)
    # at most FREQUENT rows, by that limit; rarer shingles need no count, their holders are few
    often = counts.where(F.col("times") > least).orderBy("token").toArrow()
    known = members.sparkSession.sparkContext.broadcast((often["token"].to_numpy(), often["times"].to_numpy()))

    def firsts(batches):
        tokens, times = known.value
        for batch in batches:
            found, n = [], []
            for row in batch.column("set"):
                one = row.values.to_numpy()
                at = np.minimum(np.searchsorted(tokens, one), max(0, len(tokens) - 1))
                weight = np.where(tokens[at] == one, times[at], 0) if len(tokens) else np.zeros(len(one), np.int64)
                n.append(len(one))
                found.append(one[np.lexsort((one, weight))[:len(one) - -(-len(one) * p // q) + 1]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "odd")), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "root", "odd", "n", "first"])

    first = own.mapInArrow(firsts, "node long, root long, odd boolean, n long, first array<long>")
    first = materialize(first.select("node", "root", "odd", "n", F.posexplode("first").alias("place", "token")).withColumn("place", F.col("place") + 1))
    # the smallest partner that a shingle's other holders offer bounds the place at which it still helps
    offers = first.groupBy("token").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("holders"), F.max("odd").alias("any_odd")).where("holders > 1 and any_odd")
    left = 1 + F.col("n") - F.col("place")
    helps = (p + q) * left >= p * (F.col("n") + F.greatest(F.ceil(F.col("n") * p / q), F.col("least")))
    useful = materialize(first.join(offers, "token").where(helps).select("token", "node", "root", "odd", "n", left.alias("left")))

    def side(name: str) -> DataFrame:
        return useful.select("token", F.col("odd").alias(f"odd_{name}"), F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("root", "n", "left")))

    enough = (p + q) * F.least("left_x", "left_y") >= p * (F.col("n_x") + F.col("n_y"))
    once = ~F.col("odd_y") | (F.col("x") < F.col("y"))
    return (side("x").where("odd_x").join(side("y"), "token").where("root_x <> root_y").where(once & enough).where(_close("n_x", "n_y"))
            .select("x", "y"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """``key``, ``hash``, ``first_key`` and ``first_hash`` per row: the least (key, hash) of those that similar pairs lead to.

    Needs ``key`` (no nulls), ``hash`` (of the text) and ``text``; other columns are ignored. Rows of equal shingle sets are one node, so copies
    meet nothing; null, empty and other texts without words are one node too. A text of fewer words than a shingle is one shingle. Very long texts
    are hashed in a slice of their own. Repeated rows give equal rows; an empty table gives an empty result.

    Nodes whose SimHash fingerprints op9 links, and nodes that share a band, are candidates, and candidates are compared exactly. In a bucket of up to ``PAIRWISE`` members all of them meet. In a
    larger one each member meets a central one; what is then outside the bucket's main group is looked up by an exact prefix
    filter among all members of large buckets. So a large group of near copies, or a passage shared by very many documents, costs a
    few comparisons a member, and no pair that shares a band is left out. A pair of similarity s shares none with probability (1 - s ** 5) ** 40.
    """
    sigs = materialize(map_texts(docs, lambda: _signatures, ["key", "hash"], "node long, n long, bands array<long>, fp long"))
    nodes = materialize(sigs.groupBy("node").agg(F.min(F.struct("key", "hash")).alias("least"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("fp").alias("fp")))
    pairs, crowd = _buckets(nodes)
    crowd = materialize(crowd)
    pairs = materialize(_ordered(_by_fingerprint(nodes).union(pairs).union(_stars(crowd))))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(crowd.select("node")).distinct()
    texts = nodes.join(wanted, "node").select("node", "least.key", "least.hash").join(docs.select("key", "hash", "text"), ["key", "hash"])
    sets = materialize(map_texts(texts.dropDuplicates(["key", "hash"]), lambda: _sets, ["node"], "set array<long>"))
    edges = materialize(_alike(pairs, sets))
    roots = materialize(components(edges))
    if not crowd.isEmpty():
        more = _ordered(_by_prefix(_apart(crowd, roots), sets)).join(pairs, ["a", "b"], "left_anti")
        edges = edges.union(materialize(_alike(more, sets)))
        roots = materialize(components(edges))
    linked = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = linked.groupBy("root").agg(F.min("least").alias("first"))
    named = linked.join(firsts, "root").select("node", F.col("first.key").alias("first_key"), F.col("first.hash").alias("first_hash"))
    return sigs.select("key", "hash", "node").join(named, "node").select("key", "hash", "first_key", "first_hash")
