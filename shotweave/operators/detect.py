"""Shot boundaries from frame features, model scores or predicted ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shotweave.operators.ordered import CHUNK, chunk_of, explode_range, long_keys, ordered_scan, overlap_join

# ---- fixed values --------------------------------------------------------------------
DIFF_THRESHOLD = 30.0
SCORE_THRESHOLD = 0.5
WINDOW = 100
STEP = 50
PAD = 25
HARD_CUT = 1

CLIP = ["timeline_id", "clip_id"]


# ---- consecutive differences ------------------------------------------------------------

def vector_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long numeric arrays."""
    pairs = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)


@F.pandas_udf(T.DoubleType())
def pixel_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean absolute difference of two raw 8-bit images; null when one is missing or sizes differ. Images of one size are one matrix."""
    sizes = np.array([len(x) if x is not None and y is not None and len(x) == len(y) else 0 for x, y in zip(a, b)], np.int64)
    out = np.full(len(sizes), np.nan)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.nonzero(sizes == size)[0]
        x, y = (_matrix(v.iloc[rows]).astype(np.int16) for v in (a, b))
        out[rows] = np.abs(x - y).mean(axis=1)
    return pd.Series(out)


def _matrix(images: pd.Series) -> np.ndarray:
    """Raw images of one size, a row each."""
    return np.frombuffer(b"".join(images), np.uint8).reshape(len(images), -1)


def consecutive_diffs(frames: DataFrame, kind: str = "scalar", feature: str = "feature", chunk: int | None = None) -> DataFrame:
    """Difference of every frame to the previous present frame of its source.

    ``kind``: "scalar", "vector" (arrays) or "pixels" (raw bytes). Heavy features are never aggregated:
    chunk edges are found from frame numbers alone, and only the edge frames are copied into the next
    chunk, where a window over (source, chunk) sees its predecessor.
    """
    width = chunk or CHUNK
    if kind == "scalar":
        out = ordered_scan(frames, ["source_id"], ["frame_ix"], chunk_of("frame_ix", chunk),
                           prev={"__pf": F.col(feature), "prev_ix": F.col("frame_ix")})
        diff = F.abs(F.col(feature) - F.col("__pf"))
        return out.where("prev_ix is not null").select("source_id", "frame_ix", "prev_ix", diff.alias("diff"))

    rows = frames.select("source_id", "frame_ix", F.col(feature).alias("__f"), chunk_of("frame_ix", width).alias("__ch"))
    edges = rows.groupBy("source_id", "__ch").agg(F.max("frame_ix").alias("frame_ix"))
    over = Window.partitionBy("source_id").orderBy("__ch")
    edges = edges.select("source_id", "frame_ix", F.lead("__ch").over(over).alias("__next")).where("__next is not null")
    halo = rows.join(edges, ["source_id", "frame_ix"]).select(
        "source_id", "frame_ix", "__f", F.col("__next").alias("__ch"), F.lit(True).alias("__halo"))
    both = rows.withColumn("__halo", F.lit(False)).unionByName(halo)
    w = Window.partitionBy("source_id", "__ch").orderBy("frame_ix")
    both = both.select("*", F.lag("__f").over(w).alias("__pf"), F.lag("frame_ix").over(w).alias("prev_ix"))
    both = both.where(~F.col("__halo") & F.col("prev_ix").isNotNull())
    diff = vector_diff(F.col("__f"), F.col("__pf")) if kind == "vector" else pixel_diff("__f", "__pf")
    return both.select("source_id", "frame_ix", "prev_ix", diff.alias("diff"))


def detect_cuts_diff(frames: DataFrame, threshold: float = DIFF_THRESHOLD, kind: str = "scalar", feature: str = "feature") -> DataFrame:
    """Frames that differ from their predecessor by more than the threshold.

    ``frame_ix`` is the first frame of the new shot; ``prev_ix`` tells which segments hold both frames.
    """
    return consecutive_diffs(frames, kind, feature).where(F.col("diff") > threshold)


def detect_cuts_score(scores: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Frames scored strictly above the threshold (the last frame of a shot)."""
    return scores.where(F.col("score") > threshold).select("source_id", "frame_ix", "score")


def cuts_in_segments(cuts: DataFrame, segments: DataFrame, width: int = 4096) -> DataFrame:
    """Assign source-level cuts to the clip segments that contain them.

    Cuts are sparse, so joining them beats detecting again in every clip of a source. A difference cut
    only counts when its previous frame lies in the segment too.
    """
    c = cuts.withColumn("__cut", F.col("frame_ix"))
    s = segments.select(*CLIP, "source_id", "source_in", "source_out")
    out = overlap_join(c, s, ["source_id"], ("frame_ix", "__cut"), ("source_in", "source_out"), width=width)
    if "prev_ix" in cuts.columns:
        out = out.where(F.col("prev_ix") >= F.col("source_in"))
    return out.select(*CLIP, F.col("frame_ix").alias("cut_frame"))


def cuts_to_shots(cuts: DataFrame, segments: DataFrame, convention: str = "last") -> DataFrame:
    """Turn cuts (timeline_id, clip_id, cut_frame) into shots of the segments.

    ``convention="last"``: a cut is the last frame of a shot, so the boundary is one later (this is also
    applied to difference cuts by default, which places them one frame late); ``"first"``: a cut is
    already the first frame of the new shot.
    """
    shift = 1 if convention == "last" else 0
    seg = segments.select(*CLIP, "source_id", "source_in", "source_out").where(F.col("source_out") >= F.col("source_in"))
    inner = (cuts.select(*CLIP, (F.col("cut_frame") + shift).alias("b")).distinct().join(seg, CLIP)
             .where((F.col("b") > F.col("source_in")) & (F.col("b") <= F.col("source_out"))))
    bounds = seg.withColumn("b", F.col("source_in")).unionByName(inner.select(*seg.columns, "b"))
    # a clip has no more bounds than cuts and segments, which are counted without the join
    longer = long_keys(seg.select(*CLIP).unionByName(cuts.select(*CLIP)), CLIP)
    out = ordered_scan(bounds, CLIP, ["b"], chunk_of("b"), following={"__nb": F.col("b")}, index="sub_ix", longer=longer)
    return out.select(*CLIP, "source_id", "sub_ix", F.col("b").alias("source_in"),
                      F.coalesce(F.col("__nb") - 1, F.col("source_out")).alias("source_out"))


# ---- windowed model scoring --------------------------------------------------------------

Scorer = Callable[[np.ndarray], np.ndarray]


def change_scorer(frames: np.ndarray) -> np.ndarray:
    """Deterministic stand-in for a model: change to the next frame, scaled to 0..1."""
    flat = frames.reshape(len(frames), -1).astype(np.float64)
    d = np.abs(np.diff(flat, axis=0)).mean(axis=1) / 255.0
    return np.append(d, 0.0)


def _as_array(values: np.ndarray) -> np.ndarray:
    """Features of a window, a row each: raw images, numbers or arrays."""
    first = values[0]
    if isinstance(first, (bytes, bytearray, memoryview)):
        return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
    if values.dtype != object:
        return values.reshape(-1, 1)
    return np.stack([np.atleast_1d(np.asarray(v)) for v in values])


def score_windows(frames: DataFrame, segments: DataFrame, scorer: Scorer = change_scorer, shape: tuple[int, ...] | None = None,
                  feature: str = "feature", width: int = 4096) -> DataFrame:
    """Score every frame of every segment with overlapping windows.

    Window w looks at frames 50w−25 … 50w+74 of the segment (edges repeat the first / last frame) and
    answers for frames 50w … 50w+49. Each frame is sent to the at most two windows that look at it. A window is
    one row of at most 100 frames whatever the clip or source length, and a batch of windows crosses to Python at once.
    """
    seg = segments.select(*CLIP, "source_id", "source_in", "source_out")
    f = frames.select("source_id", "frame_ix", F.col(feature).alias("__f")).withColumn("__fe", F.col("frame_ix"))
    rows = overlap_join(f, seg, ["source_id"], ("frame_ix", "__fe"), ("source_in", "source_out"), width=width)
    n = F.col("source_out") - F.col("source_in") + 1
    i = F.col("frame_ix") - F.col("source_in")
    last_w = F.floor((n - 1) / STEP)
    lo = F.greatest(F.lit(0), F.ceil((i - (STEP + PAD - 1)) / STEP)).cast("long")
    hi = F.least(last_w, F.floor((i + PAD) / STEP)).cast("long")
    rows = rows.select(*CLIP, "source_id", n.cast("long").alias("n"), i.alias("i"), F.col("source_in").alias("base"), "__f",
                       F.explode(F.sequence(lo, hi)).alias("w"))
    seen = F.array_sort(F.collect_list(F.struct("i", "__f")))
    windows = rows.groupBy(*CLIP, "w").agg(F.first("source_id").alias("source_id"), F.first("n").alias("n"), F.first("base").alias("base"), seen.alias("seen"))
    windows = windows.select(*CLIP, "source_id", "w", "n", "base", F.col("seen.i").alias("have"), F.col("seen.__f").alias("features"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(w: pd.Series, n: pd.Series, have: pd.Series, features: pd.Series) -> pd.Series:
        return pd.Series([score(*window) for window in zip(w, n, have, features)], dtype=object)

    def score(w: int, total: int, have: np.ndarray, features: np.ndarray) -> np.ndarray:
        wanted = np.clip(np.arange(WINDOW) + STEP * w - PAD, 0, total - 1)
        # a missing frame is replaced by the one before it
        pos = np.clip(np.searchsorted(have, wanted, side="right") - 1, 0, len(have) - 1)
        block = _as_array(features)[pos]
        if shape is not None:
            block = block.reshape(len(block), *shape)
        return np.asarray(scorer(block), dtype=np.float64)[PAD:PAD + STEP][:total - STEP * w]

    scored = windows.select(*CLIP, "source_id", (F.col("base") + STEP * F.col("w")).alias("start"), run("w", "n", "have", "features").alias("scores"))
    scored = scored.select(*CLIP, "source_id", "start", F.posexplode("scores").alias("place", "score"))
    return scored.select(*CLIP, "source_id", (F.col("start") + F.col("place")).alias("frame_ix"), "score")


# ---- predicted ranges ----------------------------------------------------------------------

def scan_ranges(preds: DataFrame, keys: list[str], limit: str = "usable") -> DataFrame:
    """Greedy pass over predicted range ends of a window (query_ix, end_ix).

    An end is kept when it exceeds the running start; since skipped ends never exceed it, the running
    start is the running maximum. Nothing is kept once a kept end reached the usable length.
    """
    out = ordered_scan(preds, keys, ["query_ix"], chunk_of("query_ix"), maxs={"__m": F.col("end_ix")})
    start = F.greatest(F.coalesce("__m", F.lit(0)), F.lit(0))
    out = out.withColumn("start_ix", start)
    return out.where((F.col("end_ix") > F.col("start_ix")) & ~((F.col("start_ix") > 0) & (F.col("start_ix") >= F.col(limit)))).drop("__m")


def ranges_to_cuts(ranges: DataFrame, keys: list[str], hard_only: bool = True) -> DataFrame:
    """Cuts between neighbouring ranges (range_ix, end_ix exclusive, label, total_frames).

    The cut is the last frame of a range that has a successor; with ``hard_only`` the successor must be
    labelled as following a hard cut.
    """
    out = ordered_scan(ranges, keys, ["range_ix"], chunk_of("range_ix"),
                       following={"__nl": F.struct(F.col("label").alias("v"))})
    cut = F.col("end_ix") - 1
    ok = F.col("__nl").isNotNull() & (cut >= 0) & (cut < F.col("total_frames") - 1)
    if hard_only:
        ok = ok & F.coalesce(F.col("__nl.v") == HARD_CUT, F.lit(False))
    return out.where(ok).select(*keys, cut.alias("cut"))


# ---- helpers around detection -------------------------------------------------------------

def inspection_frames(cuts: DataFrame, totals: DataFrame, around: int = 2) -> DataFrame:
    """First and last frame and every cut ± 2, inside the source, each once."""
    near = cuts.join(totals, "source_id").select(
        "source_id", "total_frames", F.explode(F.sequence(F.col("frame_ix") - around, F.col("frame_ix") + around)).alias("frame"))
    near = near.where((F.col("frame") >= 0) & (F.col("frame") < F.col("total_frames"))).select("source_id", "frame")
    first = totals.select("source_id", F.lit(0).cast("long").alias("frame"))
    last = totals.where("total_frames > 0").select("source_id", (F.col("total_frames") - 1).alias("frame"))
    return near.unionByName(first).unionByName(last).distinct()


def detect_summary(segments: DataFrame) -> DataFrame:
    return segments.agg(
        F.count_distinct("source_id").alias("n_sources"), F.count(F.lit(1)).alias("n_segments"),
        F.sum(F.col("source_out") - F.col("source_in") + 1).alias("n_frames"))


def hsv_features(width: int, height: int):
    """Column function: raw RGB bytes → HSV array (hue 0..179, saturation and value 0..255)."""
    size = width * height * 3

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def convert(pixels: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pixels:
            good = np.nonzero([p is not None and len(p) == size for p in batch])[0]
            out: list = [None] * len(batch)
            if len(good):
                for k, row in zip(good, _rgb_to_hsv(_matrix(batch.iloc[good]).reshape(-1)).reshape(len(good), -1)):
                    out[k] = row
            yield pd.Series(out)
    return convert


def _rgb_to_hsv(flat: np.ndarray) -> np.ndarray:
    rgb = flat.reshape(-1, 3).astype(np.float64)
    r, g, b = rgb.T
    v, low = rgb.max(axis=1), rgb.min(axis=1)
    span = v - low
    safe = np.where(span == 0, 1, span)
    hue = np.select([span == 0, v == r, v == g], [0 * v, 60 * (g - b) / safe, 120 + 60 * (b - r) / safe], 240 + 60 * (r - g) / safe)
    hue = np.rint(np.where(hue < 0, hue + 360, hue) / 2) % 180
    sat = np.rint(255 * span / np.where(v == 0, 1, v))
    return np.stack([hue, sat, v], axis=1).reshape(-1).astype(np.float32)
