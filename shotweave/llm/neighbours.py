"""Nearest neighbours by inner product, with a vantage-point tree per shard (operator 11)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Vectors of a shard on average, and of a tree's leaf at most.
SHARD, LEAF = 4096, 256
#: Queries (on average) and shards that meet in one task.
CELL_QUERIES, CELL_SHARDS = 2048, 4
#: Parts that the query rows of one vector are dealt to.
SPLIT = 8

_NODE = np.dtype([("vantage", "i8"), ("lo0", "f8"), ("hi0", "f8"), ("lo1", "f8"), ("hi1", "f8")])
_TREE = "shard int, points binary, nodes binary, ids array<array<long>>"


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    """The vectors with one more component that makes all of them equally long (``square`` is the greatest squared length).

    Among equally long vectors the nearest to a query (which gets a zero there) is the one with the largest inner product, so a
    metric tree can answer for inner products.
    """
    rest = np.sqrt(np.maximum(square - np.einsum("ij,ij->i", x, x), 0))
    return np.column_stack([x, rest])


def build_tree(x: np.ndarray, square: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of a vantage-point tree over lifted vectors; node k has the children 2k + 1 (the nearer half) and 2k + 2.

    The vantage point of a node is, of eight of its vectors, the one whose distances vary most. The node keeps the least and greatest
    distance of each half. Halves are equal in number, so their places follow from the node's own and ties or repeats cannot unbalance the tree.
    """
    order, found = np.arange(len(x)), {}
    rnd = np.random.default_rng(len(x))
    todo = [(0, 0, len(x))]
    while todo:
        k, first, past = todo.pop()
        if past - first <= leaf:
            continue
        own = order[first:past]
        tried, seen = rnd.choice(own, 8), rnd.choice(own, 128)
        spread = (x[tried] @ x[seen].T).var(axis=1)
        vantage = tried[int(spread.argmax())]
        far = np.sqrt(np.maximum(2 * square - 2 * (x[own] @ x[vantage]), 0))
        half = len(own) // 2
        by = np.argpartition(far, half)
        order[first:past], far = own[by], far[by]
        found[k] = (vantage, far[:half].min(), far[:half].max(), far[half:].min(), far[half:].max())
        todo += [(2 * k + 1, first, first + half), (2 * k + 2, first + half, past)]
    nodes = np.zeros(max(found, default=-1) + 1, _NODE)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    for k, (vantage, *bounds) in found.items():
        nodes[k] = (place[vantage], *bounds)
    return order, nodes


class Search:
    """The best ``k`` vectors found so far for each of some queries: larger scores first, equal scores by smaller name."""

    def __init__(self, queries: np.ndarray, k: int, square: float, factor: float):
        self.q, self.k, self.factor = queries, k, factor
        self.own = np.einsum("ij,ij->i", queries, queries)
        self.square = square
        length = np.sqrt(self.own * square)
        self.slack = 1e-15 * (queries.shape[1] + 2) * length
        self.margin = 1e-6 * (np.sqrt(self.own) + np.sqrt(square))
        self.scores = np.full((len(queries), k), -np.inf)
        self.names = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.places = np.full((len(queries), k), -1)
        self.compared = 0

    def reach(self, a: np.ndarray) -> np.ndarray:
        """Distance of the last of each query's best, and so the radius of what may still enter."""
        return np.sqrt(np.maximum(self.own[a] + self.square - 2 * self.scores[a, -1], 0))

    def tree(self, x: np.ndarray, nodes: np.ndarray, names: np.ndarray, place: int, leaf: int = LEAF) -> None:
        """Searches one shard: ``x`` holds its lifted vectors in the tree's order, ``names`` their names; ``place`` is the first one's place.

        All queries go down together; those that a subtree cannot help leave. By the triangle inequality, no vector of a
        subtree is nearer than the gap between the query's distance to the vantage point and the subtree's range of distances. The subtree is
        left out if that gap exceeds the query's reach divided by the factor: factor one loses nothing, a larger one leaves out more.
        """
        todo = [(0, 0, len(x), np.arange(len(self.q)), np.zeros(len(self.q)))]
        while todo:
            k, first, past, a, gap = todo.pop()
            near = ~(gap - self.margin[a] > self.reach(a) / self.factor)
            a, gap = a[near], gap[near]
            if not len(a):
                continue
            if past - first <= leaf:
                self.leaf(a, x[first:past], names[first:past], place + first)
                continue
            node, half = nodes[k], (past - first) // 2
            d = np.sqrt(np.maximum(self.own[a] + self.square - 2 * (self.q[a] @ x[node["vantage"], :-1]), 0))
            children = []
            for c, (lo, hi, f, p) in enumerate([(node["lo0"], node["hi0"], first, first + half), (node["lo1"], node["hi1"], first + half, past)]):
                children.append((2 * k + 1 + c, f, p, np.maximum(gap, np.maximum(lo - d, d - hi))))
            inner = d <= (node["hi0"] + node["lo1"]) / 2
            for child, own in ((1, inner), (0, ~inner), (0, inner), (1, ~inner)):
                if own.any():
                    number, f, p, bound = children[child]
                    todo.append((number, f, p, a[own], bound[own]))

    def leaf(self, a: np.ndarray, x: np.ndarray, names: np.ndarray, place: int) -> None:
        self.compared += len(a) * len(x)
        dots = self.q[a] @ x[:, :-1].T
        least = self.scores[a, -1] - self.slack[a]
        hit = dots.max(axis=1) >= least
        a, dots, least = a[hit], dots[hit], least[hit]
        if not len(a):
            return
        if len(x) > self.k:
            least = np.maximum(least, np.partition(dots, len(x) - self.k, axis=1)[:, len(x) - self.k] - self.slack[a])
        row, col = np.nonzero(dots >= least[:, None])
        # summed from the first component to the last, whatever the matrix product did
        exact = np.cumsum(self.q[a[row]] * x[col, :-1], axis=1)[:, -1] + 0.0
        rows = np.concatenate([np.repeat(np.arange(len(a)), self.k), row])
        scores = np.concatenate([self.scores[a].ravel(), exact])
        named = np.concatenate([self.names[a].ravel(), names[col]])
        places = np.concatenate([self.places[a].ravel(), place + col])
        order = np.lexsort((named, -scores, rows))
        sizes = np.bincount(rows, minlength=len(a))
        rank = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = order[rank < self.k]
        self.scores[a], self.names[a], self.places[a] = (v[order].reshape(len(a), self.k) for v in (scores, named, places))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = values.value_lengths().to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.min() == sizes.max():
        return flat.reshape(len(sizes), -1)
    made = np.zeros((len(sizes), int(sizes.max(initial=0))))
    made[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return made


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, e) of the vectors that take part, one per id."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    # -0.0 and 0.0 are one value, also as part of a grouping key
    plain = F.transform(e, lambda v: v + F.lit(0.0))
    return vectors.where(F.col("vec_id").isNotNull() & fine).select("vec_id", plain.alias("e")).groupBy("vec_id").agg(F.min("e").alias("e"))


def _build(square: float, width: int):
    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = lifted(_wide(_matrix(group["e"]), width), square)
        order, nodes = build_tree(x, square)
        made = {"shard": [key[0].as_py()], "points": [x[order].tobytes()], "nodes": [nodes.tobytes()], "ids": [group["ids"].take(pa.array(order)).to_pylist()]}
        return pa.table(made, pa.schema([("shard", pa.int32()), ("points", pa.binary()), ("nodes", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))]))

    return build


def _cell(k: int, square: float, width: int, factor: float):
    def search(queries: pa.Table, trees: pa.Table) -> pa.Table:
        schema = pa.schema([("asked", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64())), ("compared", pa.int64())])
        if not len(queries) or not len(trees):
            return schema.empty_table()
        queries = queries.combine_chunks()
        found = Search(_wide(_matrix(queries["e"]), width), k, square, factor)
        place, ids = 0, []
        for row in range(len(trees)):
            own = trees["ids"][row].values
            x = np.frombuffer(trees["points"][row].as_buffer(), np.float64).reshape(len(own), width + 1)
            firsts = own.flatten().to_numpy()[np.cumsum([0, *own.value_lengths().to_numpy()[:-1]])]
            found.tree(x, np.frombuffer(trees["nodes"][row].as_buffer(), _NODE), firsts, place)
            ids.append(own)
            place += len(own)
        row, col = np.nonzero(found.places >= 0)
        first = np.zeros(len(row), np.int64)
        if len(first):
            first[0] = found.compared
        return pa.table([queries["asked"].take(pa.array(row)), pa.array(found.scores[row, col]), pa.chunked_array(ids).combine_chunks().take(pa.array(found.places[row, col])),
                         pa.array(first)], schema=schema)

    return search


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` vectors with the largest inner product for each vector whose id ``every`` divides.

    Needs ``vec_id`` and ``embedding`` (an array of numbers); other columns are ignored. Rows whose vector is null, empty, zero or holds a null or
    non-finite component take no part, nor do rows without an id. A repeated id counts once, with the least of its vectors. Of vectors of
    different length, the shorter count as filled up with zeros. Ties go to the smaller id; a query with fewer candidates gets all of them,
    and an empty table gives an empty result. Scores are sums in double precision from the first component to the last.

    Equal vectors are one point that keeps its ``k + 1`` least ids, all that a result can need, chosen with a limit before the shuffle. Points are
    dealt to shards of about ``SHARD`` by hash; a task builds each shard's tree once, and every point is in one. Queries in blocks meet shards in
    a grid of cells of bounded size, each one task, which hands on the ``k + 1`` best points of each of its queries. ``factor`` relaxes the pruning: at
    one, the default, the result is exact; above one, subtrees that could only just help are left out.
    """
    one = materialize(_usable(vectors))
    rank = F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))
    points = materialize(one.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("e").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    n, square, width = points.agg(F.count(F.lit(1)), F.max(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v)), F.max(F.size("e"))).first()
    square, width = float(square or 0) * (1 + 1e-12), int(width or 1)
    asking = one.where(F.col("vec_id") % every == 0)
    asked = materialize(points.join(asking.select("e").distinct(), "e", "left_semi").select(F.col("ids")[0].alias("asked"), "e"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SPLIT)).cast("int").alias("salt")
    links = asking.select(F.col("vec_id").alias("query_id"), "e", salt).join(asked.select("asked", "e", salts), ["e", "salt"]).select("query_id", "asked", "salt")

    shards = max(1, -(-n // SHARD))
    dealt = points.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int").alias("shard"), "e", "ids")
    trees = materialize(dealt.groupBy("shard").applyInArrow(_build(square, width), _TREE))
    lanes, blocks = -(-shards // CELL_SHARDS), max(1, -(-asked.count() // CELL_QUERIES))
    block = F.pmod(F.xxhash64("asked"), F.lit(blocks)).cast("int").alias("block")
    left = asked.select("asked", "e", block, F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    right = trees.select("points", "nodes", "ids", (F.col("shard") % lanes).alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = left.groupBy("block", "lane").cogroup(right.groupBy("block", "lane"))
    found = met.applyInArrow(_cell(k + 1, square, width, factor), "asked long, score double, ids array<long>, compared long")
    best = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), F.col("ids")[0]))
    rows = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("vec_id")))))
    top = (found.withColumn("best", best).where(F.col("best") <= k + 1).groupBy("asked").agg(F.slice(F.array_sort(rows), 1, k + 1).alias("top")))
    own = links.join(top.select("asked", "top", salts), ["asked", "salt"])
    given = own.select("query_id", F.posexplode(F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)).alias("at", "t"))
    return given.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("t.less")).alias("score"))


def oracle_sql(k: int = 20, every: int = 20) -> str:
    return f"""
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
