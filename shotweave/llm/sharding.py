"""Sharding of indivisible groups by best-fit-decreasing bin packing (operator 1)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Bits of a group's size that tell sizes apart when bins are planned: sizes below 2 ** SIZE_BITS are exact, larger ones are rounded up by
#: under one part in 2 ** (SIZE_BITS - 1). So the size table has at most 2 ** (SIZE_BITS - 1) rows per doubling, however many groups there are.
SIZE_BITS = 12
ROW_BYTES = 16
#: The capacity is settled to this part of a bin's fair share.
SETTLED = 1 / 20_000
#: A group with more than this share of all rows is looked up by broadcast: there are at most 1 / HEAVY of them.
HEAVY = 1 / 1000


class CapacityTree:
    """Remaining capacities of bins in a balanced (AVL) tree, ordered by (remaining, bin)."""

    def __init__(self):
        self._root = None  # a node is (key, left, right, height)

    @staticmethod
    def _node(key, left, right):
        return key, left, right, 1 + max(left[3] if left else 0, right[3] if right else 0)

    @classmethod
    def _balanced(cls, key, left, right):
        tall = lambda n: n[3] if n else 0
        if tall(left) > tall(right) + 1:
            if tall(left[1]) < tall(left[2]):
                a, b = left, left[2]
                left = cls._node(b[0], cls._node(a[0], a[1], b[1]), b[2])
            return cls._node(left[0], left[1], cls._node(key, left[2], right))
        if tall(right) > tall(left) + 1:
            if tall(right[2]) < tall(right[1]):
                a, b = right, right[1]
                right = cls._node(b[0], b[1], cls._node(a[0], b[2], a[2]))
            return cls._node(right[0], cls._node(key, left, right[1]), right[2])
        return cls._node(key, left, right)

    @classmethod
    def _insert(cls, n, key):
        if n is None:
            return cls._node(key, None, None)
        if key < n[0]:
            return cls._balanced(n[0], cls._insert(n[1], key), n[2])
        return cls._balanced(n[0], n[1], cls._insert(n[2], key))

    @classmethod
    def _remove(cls, n, key):
        if key < n[0]:
            return cls._balanced(n[0], cls._remove(n[1], key), n[2])
        if key > n[0]:
            return cls._balanced(n[0], n[1], cls._remove(n[2], key))
        if n[1] is None or n[2] is None:
            return n[1] or n[2]
        least = n[2]
        while least[1]:
            least = least[1]
        return cls._balanced(least[0], n[1], cls._remove(n[2], least[0]))

    def add(self, remaining: int, number: int) -> None:
        self._root = self._insert(self._root, (remaining, number))

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity that is at least ``size``."""
        n, best = self._root, None
        while n:
            if n[0][0] >= size:
                best, n = n[0], n[1]
            else:
                n = n[2]
        if best:
            self._root = self._remove(self._root, best)
        return best


@dataclass(frozen=True)
class Placed:
    """Groups ``first`` up to ``past`` (by their number among those of the size) go to the bin."""

    size: int
    first: int
    past: int
    number: int


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[Placed] | None:
    """Packs ``(size, count)`` groups, largest first, each into the tightest bin that holds it, opening bins as needed.

    Groups of one size follow each other into one bin for as long as it holds them, as it stays the tightest. None if more than ``most``
    bins would be opened, or a group exceeds the capacity.
    """
    tree, opened, out = CapacityTree(), 0, []
    for size, count in sorted(sizes, reverse=True):
        first = 0
        while first < count:
            found = tree.take_tightest(size)
            if found is None:
                if size > capacity or opened == most:
                    return None
                found, opened = (capacity, opened), opened + 1
            remaining, number = found
            n = min(count - first, remaining // size if size else count)
            out.append(Placed(size, first, first + n, number))
            tree.add(remaining - n * size, number)
            first += n
    return out


def plan_bins(sizes: list[tuple[int, int]], bins: int) -> list[Placed]:
    """The packing into ``bins`` bins whose common capacity is the least that best-fit decreasing manages, by bisection.

    A group larger than a fair share of what is left gets a bin of its own first, so that it does not widen the others.
    """
    left = sorted(([s, n] for s, n in sizes if n), reverse=True)
    total, out, free = sum(s * n for s, n in left), [], bins
    taken: dict[int, int] = {}
    while left and free > 1 and left[0][0] * free >= total:
        size = left[0][0]
        k = taken.get(size, 0)
        out.append(Placed(size, k, k + 1, bins - free))
        taken[size], free, total = k + 1, free - 1, total - size
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
    rest = [(s, n) for s, n in left]
    if rest:
        fair = math.ceil(total / free)
        low, high = max(fair, rest[0][0]), None
        step = max(1, int(fair * SETTLED))
        best = best_fit_decreasing(rest, low, free)
        reach = max(step, rest[0][0])
        while best is None:  # a bin more than the largest group above the fair share always suffices
            high = low + reach
            best = best_fit_decreasing(rest, high, free)
            low, reach = (low, reach) if best else (high, 2 * reach)
        while high is not None and high - low > step:
            middle = (low + high) // 2
            found = best_fit_decreasing(rest, middle, free)
            best, low, high = (found, low, middle) if found else (best, middle, high)
        out += [Placed(p.size, p.first + taken.get(p.size, 0), p.past + taken.get(p.size, 0), p.number + bins - free) for p in best]
    return out


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Adds a gapless number from 0 within ``keys``; ``order`` names columns that tell the rows apart and decide the order in a cell.

    A key's rows are dealt to about sqrt(``rows``) / 4 cells by hash, numbered in their cell and shifted by what the cells before hold, so no
    key is numbered by one task. ``df`` is read twice and should be stored.
    """
    cells = max(1, math.isqrt(rows) // 4)
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    held = dealt.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cols = ", ".join(f"`{k}`" for k in keys)
    before = held.select(*keys, "_cell", F.expr(f"coalesce(sum(_n) over (partition by {cols} order by _cell rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    own = dealt.withColumn("_own", F.expr(f"row_number() over (partition by {cols}, _cell order by {', '.join(f'`{o}`' for o in order)})"))
    return own.join(before, [*keys, "_cell"]).withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_cell", "_own", "_before")


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Each document's ``doc_id``, ``size``, ``text_crc32``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    Documents of equal text are one group and share a shard; the shards' sizes are as near to each other as indivisible groups allow. A size is the
    text's bytes plus ``ROW_BYTES``; null texts are one group of their own and have no bytes. Repeated rows are rows of their group; an empty table
    gives an empty result. Other columns are ignored. Texts are hashed where they are read and never shuffled. The driver plans with a bounded
    table of sizes and counts; the plan, at most a row per size and bin, is broadcast. The groups themselves stay distributed.
    """
    text = F.col("text").cast("string")
    rows = materialize(docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("")).alias("group"), F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    bits = F.length(F.bin("bytes"))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(bits - SIZE_BITS, F.lit(0)))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.withColumn("class", (F.floor((F.col("bytes") + unit - 1) / unit) * unit).cast("long")))
    table = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    plan = plan_bins([(r["class"], r["n"]) for r in table], shards)
    spark = docs.sparkSession
    planned = spark.createDataFrame([(p.size, p.first, p.past, p.number) for p in plan], "size_class long, first long, past long, shard int")
    ranked = numbered(groups, ["class"], ["group"], "rank", sum(r["n"] for r in table))
    placed = ranked.join(F.broadcast(planned), (F.col("class") == F.col("size_class")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    placed = materialize(placed.select("group", "n", "shard"))
    least = max(2, math.ceil(total * HEAVY))
    heavy = F.broadcast(placed.where(F.col("n") >= least).select("group", "shard"))
    light = placed.where(F.col("n") < least).select("group", "shard")
    assigned = rows.join(heavy, "group").union(rows.join(heavy, "group", "left_anti").join(light, "group"))
    assigned = materialize(assigned.select("doc_id", "size", "text_crc32", "row", "shard"))
    return numbered(assigned, ["shard"], ["row"], "slot", total).drop("row")


def write_shards(docs: DataFrame, target: str, shards: int = 40, rows_per_file: int = 100_000) -> None:
    """Writes the documents, all columns and their slot, to one folder per shard, in files of at most ``rows_per_file`` rows.

    ``doc_id`` must tell rows apart for this; the texts are shuffled once, to their shard and slot block.
    """
    where = assign_shards(docs, shards).select("doc_id", "shard", "slot")
    out = docs.join(where, "doc_id").repartition("shard", F.floor(F.col("slot") / rows_per_file)).sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(target)
