"""Golden values of track sampling, crops and windows, and a scalar twin of the curve rules."""

import random

import pytest
from pyspark.sql import functions as F

from shotweave.functions import expr as X
from shotweave.operators import crops as cr, keyframes as kf

KEY = "crop_id string, axis string, source_frame long, value double, interp string, in_dx double, in_dy double, out_dx double, out_dy double"
CROP = "crop_id string, x long, y long, w long, h long, aspect_ratio string, custom_ratio_w long, custom_ratio_h long"


def keys(spark, rows):
    return spark.createDataFrame([(c, a, f, float(v), i, *(h or (0.0,) * 4)) for c, a, f, v, i, h in rows], KEY)


def at(spark, k, frames, crop="c"):
    pts = spark.createDataFrame([(crop, f) for f in frames], "crop_id string, frame long")
    return {r.frame: r.value for r in kf.sample_tracks(k, pts).collect()}


def test_linear_and_step(spark, tiny_chunks):
    k = keys(spark, [("c", "x", 0, 100, "linear", None), ("c", "x", 10, 200, "linear", None)])
    assert at(spark, k, [-5, 0, 5, 10, 15]) == {-5: 100, 0: 100, 5: 150, 10: 200, 15: 200}
    s = keys(spark, [("c", "x", 0, 100, "step", None), ("c", "x", 10, 200, "linear", None)])
    assert at(spark, s, [5, 10]) == {5: 100, 10: 200}
    # an inner key belongs to the pair that ends there
    m = keys(spark, [("c", "x", 0, 100, "step", None), ("c", "x", 10, 200, "linear", None), ("c", "x", 20, 0, "linear", None)])
    assert at(spark, m, [10, 15, 20]) == {10: 100, 15: 100, 20: 0}
    one = keys(spark, [("c", "x", 7, 3, "linear", None)])
    assert at(spark, one, [0, 7, 99]) == {0: 3, 7: 3, 99: 3}


def bezier(p0, p1, p2, p3, t):
    """Independent check: bisection on a monotone curve."""
    def c(u, i):
        v = 1 - u
        return v ** 3 * p0[i] + 3 * v * v * u * p1[i] + 3 * v * u * u * p2[i] + u ** 3 * p3[i]
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if c(mid, 0) < t else (lo, mid)
    return c(lo, 1)


def test_bezier(spark):
    h = (-3.0, 2.0, 4.0, -6.0)
    k = keys(spark, [("c", "x", 0, 10, "linear", h), ("c", "x", 20, 50, "bezier", h)])
    got = at(spark, k, range(0, 21))
    for t in range(1, 20):
        assert got[t] == pytest.approx(bezier((0, 10), (4, 4), (17, 52), (20, 50), t), abs=1e-6)
    assert got[0] == 10 and got[20] == 50


def test_crop_rectangles(spark):
    crops = spark.createDataFrame([("c", 50, 60, 200, 100, "free", 0, 0), ("l", 0, 0, 1920, 999, "16:9", 0, 0)], CROP)
    k = keys(spark, [("c", "x", 0, 10, "linear", None), ("c", "x", 10, 30, "linear", None)])
    pts = spark.createDataFrame([("c", 5), ("l", 3)], "crop_id string, frame long")
    got = {r.crop_id: (r.x, r.y, r.w, r.h) for r in kf.sample_crops(crops, k, pts).collect()}
    assert got == {"c": (20, 60, 200, 100), "l": (0, 0, 1920, 1080)}


def test_output_dims(spark):
    df = spark.createDataFrame([(1920, 1080, 512), (1991, 1991, 513)], "w long, h long, ow long")
    got = [tuple(r.o) for r in df.select(X.crop_output_dims("w", "h", "w", "h", "ow").alias("o")).collect()]
    assert got == [(512, 288), (512, 512)]


@pytest.mark.parametrize("seed", [42, 1337])
def test_window_geometry_equals_per_frame_sampling(spark, tiny_chunks, seed):
    rng = random.Random(seed)
    crops, rows, wins = [], [], []
    for c in "abcdef":
        crops.append((c, 0, 0, rng.randint(20, 90), rng.randint(20, 90), rng.choice(["free", "16:9"]), 0, 0))
        for ax in ("w", "h", "x"):
            for f in sorted(rng.sample(range(0, 200, 3), rng.choice([0, 1, 4]))):
                rows.append((c, ax, f, rng.randint(-3, 90), rng.choice(["linear", "step", "bezier"]), (-2.0, 1.0, 2.0, -1.0)))
        wins += [(c, f"{c}{i}", rng.randint(0, 120), 24.0) for i in range(3)]
    cd, k = spark.createDataFrame(crops, CROP), keys(spark, rows)
    w = spark.createDataFrame(wins, "crop_id string, segment_id string, anchor_frame long, fps double")
    got = {r.segment_id: r for r in cr.window_geometry(w, cd, k).collect()}
    frames = cr.expand_segments(w)
    rect = kf.sample_crops(cd, k, frames)
    per = {}
    for r in frames.join(rect, ["crop_id", "frame"]).collect():
        per.setdefault(r.segment_id, []).append((r.k, r.w, r.h))
    for seg, fr in per.items():
        fr.sort()
        g = got[seg]
        best = max(((w_, -k_, h_) for k_, w_, h_ in fr if w_ > 0), default=None)
        assert (g.best_w, g.best_h) == ((best[0], best[2]) if best else (None, None))
        assert (g.anchor_w, g.anchor_h) == fr[0][1:]
        if g.animated:
            ok = all(a > 0 and b > 0 for _, a, b in fr)
            ratios = [a / b for _, a, b in fr] if ok else []
            assert g.aspect_constant == (ok and (max(ratios) - min(ratios)) / min(ratios) <= 0.03)
        else:
            assert g.aspect_constant


def test_key_edits(spark):
    h = (1.0, 2.0, 3.0, 4.0)
    k = keys(spark, [("c", "x", 0, 1, "linear", h), ("c", "x", 5, 2, "step", h), ("c", "x", 9, 3, "bezier", h)])
    moves = spark.createDataFrame([("c", "x", 0, 5, 7.0, 1)], "crop_id string, axis string, old_frame long, new_frame long, new_value double, edit_seq int")
    sets = spark.createDataFrame([("c", "x", 9, 8.0, "bezier", 1), ("c", "x", 20, 4.0, "linear", 2)], "crop_id string, axis string, source_frame long, value double, interp string, edit_seq int")
    got = {r.source_frame: (r.value, r.interp, r.in_dx) for r in kf.apply_key_edits(k, moves=moves, sets=sets).collect()}
    assert got == {5: (7.0, "linear", 1.0), 9: (8.0, "bezier", 1.0), 20: (4.0, "linear", 0.0)}


def test_geometry_looks_up_each_crop_once(spark):
    """Windows that carry their crop's columns are not joined with the crops again; the frames of a moving crop carry its size along."""
    from shotweave.operators import crops as cr

    c = spark.sql("select concat('k', id) as crop_id, 0L as x, 0L as y, 20L as w, 10L as h, 'free' as aspect_ratio, 0L as custom_ratio_w, 0L as custom_ratio_h from range(4)")
    w = c.selectExpr("*", "concat('s', crop_id) as segment_id", "5L as anchor_frame", "24.0D as fps")
    keys = spark.sql("select concat('k', id) as crop_id, 'w' as axis, explode(array(5L, 45L)) as source_frame, 30D as value, 'step' as interp, 0D as in_dx, 0D as in_dy, 0D as out_dx, 0D as out_dy from range(2)")
    geo = cr.window_geometry(w, c.where("false"), keys)
    assert {(r.crop_id, r.animated, r.base_w, r.anchor_w, r.best_w) for r in geo.collect()} == {
        ("k0", True, 20, 30, 30), ("k1", True, 20, 30, 30), ("k2", False, 20, 20, 20), ("k3", False, 20, 20, 20)}
    plain = cr.window_geometry(w.select("crop_id", "segment_id", "anchor_frame", "fps"), c, keys)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, geo.collect()))
