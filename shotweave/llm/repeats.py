"""Periodic runs of words by an online sparse diagonal recurrence (operator 12)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words that any run matches on its diagonal at least: the least of max(24 - q, 2 * q) over all periods q, 16.
WINDOW = min(max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) for q in range(1, LEAST_WORDS))


def looped(n: int, doc_id: int) -> np.ndarray:
    """Numbers of the words that a document of ``n`` words shows: one document in ten repeats a part of its own up to its end."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def occurrences(words: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per window length: ends of windows, distance to the window's nearest earlier occurrence in the document, and the window's length.

    ``words`` numbers the words of several documents (documents share no number; -1: occurs once), ``last`` is the end of each word's document. Windows of
    16, 32, 64 … words answer for the distances up to their length (from half of it on), which is enough: a run of period q
    matches at least max(16, 2 * q) words, and inside it the nearest earlier occurrence of a window of q words or more lies exactly q
    back, since the period's word is primitive. So a word has one earlier occurrence per length to look at, however often it occurs.
    Numbers of windows of twice the length come from pairs of numbers; a window that occurs once is never looked at again.
    """
    ids, width = words, 1
    at = np.flatnonzero(ids >= 0)
    while len(at):
        if width >= WINDOW:
            order = np.argsort(ids[at], kind="stable")
            p = at[order]
            same = np.flatnonzero(ids[p[1:]] == ids[p[:-1]]) + 1
            lag = p[same] - p[same - 1]
            ok = (lag <= width) & ((lag > width // 2) | (width == WINDOW))
            yield p[same][ok] + width - 1, lag[ok], np.full(int(ok.sum()), width)
        at = at[at + 2 * width <= last[at]]
        at = at[ids[at + width] >= 0]
        if not len(at):
            return
        pair = ids[at] * (int(ids.max()) + 1) + ids[at + width]
        _, number, times = np.unique(pair, return_inverse=True, return_counts=True)
        ids = np.full(len(words), -1)
        ids[at] = np.where(times[number] > 1, number, -1)
        at = at[ids[at] >= 0]
        width *= 2


def diagonals(events: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) from (word, lag, window) in the order of the words, each as soon as its diagonal ends.

    The state is the match length of each active lag. An earlier occurrence makes its lag one longer, or opens it with the words
    of its window; a lag that the word does not match has ended, and is a run if it is long enough.
    """
    active: dict[int, int] = {}
    step: dict[int, int] = {}
    now = -2

    def ended(lags: dict[int, int], at: int) -> Iterator[tuple[int, int, int]]:
        for q, m in lags.items():
            if q + m >= max(LEAST_WORDS, LEAST_PERIODS * q):
                yield at - q - m + 1, q + m, q

    for word, lag, window in events:
        if word != now:
            yield from ended(active, now - 1)
            active, step = step, {}
            if word != now + 1:
                yield from ended(active, now)
                active = {}
            now = word
        step[lag] = active.pop(lag, window - 1) + 1
    yield from ended(active, now - 1)
    yield from ended(step, now)


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The runs of several documents, whose words are numbered one after another, by start, and whose ends are ``bounds``."""
    last = np.repeat(bounds, np.diff(bounds, prepend=0))
    found = list(occurrences(np.where(np.bincount(words)[words] > 1, words, -1), last))
    if not found:
        return np.zeros(0, int), []
    at, lag, width = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((lag, at))
    runs = sorted(diagonals(zip(at[order].tolist(), lag[order].tolist(), width[order].tolist(), strict=True)), key=lambda r: (r[0], r[2]))
    return np.searchsorted(bounds, [r[0] for r in runs], "right"), runs


def summary(runs: list[tuple[int, int, int]]) -> tuple:
    """Start, length, period and 1000 times the exponent of the run with the greatest exact exponent; ties: least start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])


def measure(ids: list, texts: list, collapsed: bool) -> dict:
    """Runs, their digests and the collapsed texts of one slice of documents."""
    shown, sizes, codes, book = [], [], [], {}
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        words = (t or b"").split()
        at = looped(len(words), i) if i is not None else np.arange(len(words))
        if i is not None and len(words) and at[-1] != len(words) - 1:
            words = [words[j] for j in at.tolist()]
        shown.append(words)
        sizes.append(len(words))
        book.clear()
        codes.append(np.fromiter((book.setdefault(w, len(book)) for w in words), np.int64, len(words)))
    base = np.cumsum([0, *(int(c.max()) + 1 if len(c) else 0 for c in codes)])
    bounds = np.cumsum(sizes)
    flat = np.concatenate([c + b for c, b in zip(codes, base, strict=False)]) if codes else np.zeros(0, np.int64)
    owner, runs = find_runs(flat, bounds)
    edges = np.searchsorted(owner, np.arange(len(ids) + 1))
    out = {"n_runs": [], "start": [], "length": [], "period": [], "exponent_milli": [], "runs_sha256": [], "collapsed_sha256": []}
    if collapsed:
        out |= {"runs": [], "collapsed": []}
    for k, words in enumerate(shown):
        zero = int(bounds[k]) - sizes[k]
        own = [(s - zero, n, q) for s, n, q in runs[edges[k]:edges[k + 1]]]
        if own:
            gone = np.zeros(len(words) + 1, np.int64)
            for s, n, q in own:
                gone[s + q] += 1
                gone[s + n] -= 1
            words = [words[j] for j in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        text = b" ".join(words)
        values = len(own), *summary(own), hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest(), hashlib.sha256(text).hexdigest()
        for c, v in zip(out, values, strict=False):
            out[c].append(v)
        if collapsed:
            out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in own])
            out["collapsed"].append(text.decode())
    if collapsed:
        out["runs"] = pa.array(out["runs"], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
    return out | {c: pa.array(out[c], pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")}


def periodic_runs(docs: DataFrame, keep: list[str] | None = None, collapsed: bool = True) -> DataFrame:
    """One row per document: its id, ``n_runs``, the greatest run, digests and, if ``collapsed``, all ``runs`` and the ``collapsed`` text.

    Needs ``doc_id`` and ``text``; ``keep`` names further columns to hand on. Texts are looked at where they are read, without a shuffle, in slices
    of ``SLICE_BYTES`` (a longer text by itself); the work per slice grows as words times the logarithm of the longest period, also for
    a text of one word repeated. A null or empty text has no words and no runs. A text without an id is searched as it is. Repeated
    rows give equal rows, and an empty table gives an empty result.
    """
    cols = ["doc_id", *(keep or [])]
    out = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    out += ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if collapsed else ""
    return map_texts(docs, lambda: lambda texts, ids: measure(ids, texts, collapsed), cols, out, with_keys="doc_id")
