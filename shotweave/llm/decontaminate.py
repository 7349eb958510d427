"""Benchmark decontamination by winnowing (operator 4)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import map_texts

#: Words of a benchmark window, and of the grams whose hashes are winnowed. A run of ``WINDOW`` shared words has
#: ``WINDOW - GRAM + 1`` consecutive shared grams, hence one shared least hash.
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
SIDE = WINDOW - GRAM
CONTEXT = GRAM + 2 * SIDE
#: Largest filter of benchmark fingerprints that is sent to the executors, as a power of two of its bits (16 MiB). A larger benchmark
#: makes the filter pass more candidates, which the join then drops.
FILTER_BITS = 27
_BLOCK = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_CODES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and how many words each text has."""
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    raw = _LOWER[np.frombuffer(b"\0".join(t or b"" for t in texts) + b"\0", np.uint8)]
    inside = _WORD[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * _powers(_BASE, len(raw)), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_INVERSE, len(raw))[starts]
    counts = np.diff(np.searchsorted(starts, np.cumsum(sizes)), prepend=0)
    return _mix(h + (ends - starts).astype(np.uint64)) | np.uint64(2), counts  # 0 and 1 stay free for the edges of texts


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k:len(words) - n + 1 + k]
    return _mix(h)


def _winnow(grams: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Positions of the rightmost least hash of every run of ``SPAN`` grams whose start is ``whole`` (its window lies in one text)."""
    if len(grams) < SPAN:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams, SPAN)
    at = np.nonzero(whole[:len(runs)])[0]
    return np.unique(at + SPAN - 1 - runs[at, ::-1].argmin(1))


def _contexts(words: np.ndarray, counts: np.ndarray, text: np.ndarray, at: np.ndarray, edge: int) -> np.ndarray:
    """Hashes of the ``CONTEXT`` words around grams that begin ``at``; beyond the text, ``edge``."""
    first = np.cumsum(counts) - counts
    where = at[:, None] + np.arange(-SIDE, GRAM + SIDE)
    own = text[at]
    out = (where < first[own][:, None]) | (where >= (first + counts)[own][:, None])
    got = words[np.clip(where, 0, max(0, len(words) - 1))]
    got[out] = edge
    return got


def _factory(bits=None, lengths: tuple[int, ...] = (), power: int = 0):
    """Fingerprints per text. With a filter: of documents, those that the filter knows; without: of benchmark items, all."""
    known = np.frombuffer(bits.value, np.uint8) if bits is not None else None

    def passing(h: np.ndarray) -> np.ndarray:
        k = h >> np.uint64(64 - power)
        return known[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8) & 1 == 1

    def work(texts):
        words, counts = word_hashes(texts)
        text = np.repeat(np.arange(len(texts)), counts)
        found = []  # window, position, fingerprint
        g = _grams(words, GRAM)
        at = _winnow(g, text[:max(0, len(words) - WINDOW + 1)] == text[WINDOW - 1:])
        found.append((WINDOW, at, g[at]))
        for n in lengths:
            g = _grams(words, n)
            whole = text[:len(g)] == text[n - 1:]
            if known is None:  # an item shorter than the window is one window, at its first word
                whole &= (counts[text[:len(g)]] == n)
            at = np.nonzero(whole)[0]
            found.append((n, at, g[at]))
        if known is not None:
            found = [(n, at[ok], h[ok]) for n, at, h in found for ok in [passing(h)]]
        n = np.concatenate([np.full(len(at), n, np.int32) for n, at, _ in found])
        at = np.concatenate([at for _, at, _ in found])
        fp = np.concatenate([h for _, _, h in found]).view(np.int64)
        ctx = _contexts(words, counts, text, at, 1 if known is None else 0)
        ctx[n < WINDOW, :SIDE] = 0
        for k in lengths:
            ctx[n == k, SIDE + k:] = 0
        order = np.argsort(text[at], kind="stable")
        per = np.bincount(text[at], minlength=len(texts)) if len(at) else np.zeros(len(texts), np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
        pos = (at - (np.cumsum(counts) - counts)[text[at]])[order].astype(np.int32)
        hits = pa.StructArray.from_arrays([
            pa.array(n[order]), pa.array(fp[order]), pa.array(pos),
            pa.Array.from_buffers(pa.binary(CONTEXT * 8), len(order), [None, pa.py_buffer(ctx[order].tobytes())]).cast(pa.binary()),
        ], names=["win", "fp", "pos", "ctx"])
        return {"n_words": pa.array(counts), "hits": pa.ListArray.from_arrays(offsets, hits)}

    return work


_RUN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("past", T.IntegerType())])
_FOUND = "n_words long, hits array<struct<win: int, fp: long, pos: int, ctx: binary>>"


def _known(fps: DataFrame) -> tuple[bytes, int]:
    """A one-hash filter of the fingerprints, of 2 ** power bits: built in blocks of 64 KiB by the executors."""
    power = min(FILTER_BITS, max(19, math.ceil(math.log2(1 + 64 * fps.count()))))
    width = (1 << power) // 8

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        b = np.zeros(_BLOCK, np.uint8)
        b[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [np.packbits(b, bitorder="little").tobytes()]})

    k = F.shiftrightunsigned("fp", 64 - power)
    parts = (fps.select(F.floor(k / _BLOCK).cast("int").alias("block"), (k % _BLOCK).cast("int").alias("bit")).distinct()
             .groupBy("block").applyInPandas(block, "block int, bits binary"))
    out = bytearray(width)
    for r in parts.toLocalIterator():
        out[r["block"] * _BLOCK // 8:(r["block"] + 1) * _BLOCK // 8] = r["bits"]
    return bytes(out), power


@F.pandas_udf(_RUN)
def _extend(win: pd.Series, pos: pd.Series, ctx: pd.Series, other: pd.Series) -> pd.DataFrame:
    """The run of equal words around a shared gram, as word positions; empty (0, 0) if it is shorter than the window."""
    n, p = win.to_numpy(np.int64), pos.to_numpy(np.int64)
    a, b = (np.frombuffer(b"".join(x), np.uint64).reshape(-1, CONTEXT) for x in (ctx, other))
    same = a == b
    left = np.logical_and.accumulate(same[:, SIDE - 1::-1], axis=1).sum(1)
    right = np.logical_and.accumulate(same[:, SIDE + GRAM:], axis=1).sum(1)
    centre = same[:, SIDE:SIDE + GRAM].all(1)
    short, full = n < WINDOW, same.all(1)
    first, past = np.where(short, p, p - left), np.where(short, p + n, p + GRAM + right)
    ok = np.where(short, full, centre & (past - first >= WINDOW))
    return pd.DataFrame({"first": np.where(ok, first, 0).astype(np.int32), "past": np.where(ok, past, 0).astype(np.int32)})


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", short_items: bool = True) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` words inside a benchmark window, ``n_items`` that have such a window, ``items`` (their ids
    as strings, sorted), and ``contaminated``.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; ``keep`` names more document columns to return. Null and
    empty texts have no words. Benchmark items of equal words are looked up once; an item without an id marks words, but is not
    listed. With ``short_items`` off, only full windows count, and an item of fewer words than a window marks nothing. Repeated rows get equal results; an empty benchmark marks nothing. Word equality is that of 64-bit hashes of all
    the words of a run. Texts are read once and not shuffled: only fingerprints that the bounded filter passes reach the join, with
    the hashes of the words around them, so that hits are extended without going back to a text.
    """
    keep = keep or []
    short = tuple(range(1, WINDOW)) if short_items else ()
    items = materialize(map_texts(benchmark.select("item_id", "text", F.xxhash64("text").alias("same")), lambda: _factory(lengths=short),
                                  ["item_id", "same"], _FOUND))
    listed = items.select(F.xxhash64("same", "n_words", F.col("hits.fp")).alias("gid"), "item_id", "hits")
    prints = (listed.select("gid", F.explode("hits").alias("h")).select("gid", "h.win", "h.fp", F.col("h.ctx").alias("other")).distinct())
    prints = materialize(prints)
    lengths = tuple(sorted(r["win"] for r in prints.select("win").distinct().collect() if r["win"] < WINDOW))
    bits, power = _known(prints.select("fp").distinct())
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    named = docs.select("doc_id", *keep, F.xxhash64(text).alias("tkey"), *([] if "." in text else [text]))
    seen = materialize(map_texts(named, lambda: _factory(sent, lengths, power), ["doc_id", *keep, "tkey"], _FOUND, text=text))
    found = seen.where(F.size("hits") > 0).select("doc_id", "tkey", F.explode("hits").alias("h")).select("doc_id", "tkey", "h.*")
    runs = (found.join(prints, ["win", "fp"]).select("doc_id", "tkey", "gid", _extend("win", "pos", "ctx", "other").alias("r"))
            .where("r.past > r.first").distinct())
    runs = materialize(runs)
    covered = F.aggregate(F.sort_array(F.collect_set("r")), F.struct(F.lit(0).alias("n"), F.lit(0).alias("past")), lambda acc, r: F.struct(
        (acc["n"] + F.greatest(F.lit(0), r["past"] - F.greatest(r["first"], acc["past"]))).alias("n"), F.greatest(acc["past"], r["past"]).alias("past")))
    words = runs.groupBy("doc_id", "tkey").agg(covered["n"].cast("long").alias("n_hit"))
    ids = (runs.select("doc_id", "tkey", "gid").distinct().join(listed.select("gid", F.col("item_id").cast("string").alias("item_id")).distinct(), "gid")
           .groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    both = words.alias("w").join(ids.alias("i"), F.col("w.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("w.tkey") == F.col("i.tkey")), "left")
    both = both.select(F.col("w.doc_id").alias("hit_id"), F.col("w.tkey").alias("hit_key"), "n_hit", "items")
    none = F.array().cast("array<string>")
    return (seen.join(both, F.col("doc_id").eqNullSafe(F.col("hit_id")) & F.col("tkey").eqNullSafe(F.col("hit_key")), "left")
            .select("doc_id", *keep, F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", none).alias("items"))
            .withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0))
