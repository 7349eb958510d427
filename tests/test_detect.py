"""Detection: chunk carries, window scoring against a direct loop, and the stream against the batch."""

import datetime as dt_
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotweave.operators import detect as dt
from shotweave.streaming.shots import detect_cuts_stream, dropped_by_watermark


def test_cuts_across_chunks(spark, tiny_chunks):
    feats = [0, 0, 50, 50, 0, 0, 0, 99, 99, 0, 40, 40]
    rows = [("h", i, float(v), [float(v), 0.0], bytes([int(v)] * 12)) for i, v in enumerate(feats) if i != 5]
    df = spark.createDataFrame(rows, "source_id string, frame_ix long, s double, v array<double>, p binary")
    want = [2, 4, 7, 9, 10]
    assert sorted(r.frame_ix for r in dt.detect_cuts_diff(df, 30.0, "scalar", "s").collect()) == want
    assert sorted(r.frame_ix for r in dt.detect_cuts_diff(df, 15.0, "vector", "v").collect()) == want
    assert sorted(r.frame_ix for r in dt.detect_cuts_diff(df, 30.0, "pixels", "p").collect()) == want


@pytest.mark.parametrize("n", [1, 49, 50, 51, 130])
def test_score_windows(spark, n):
    vals = [float((i * 37) % 251) for i in range(n + 20)]
    f = spark.createDataFrame([("s", i, [v]) for i, v in enumerate(vals)], "source_id string, frame_ix long, feature array<double>")
    seg = spark.createDataFrame([("t", "c", "s", 10, 10 + n - 1)], "timeline_id string, clip_id string, source_id string, source_in long, source_out long")

    def scorer(block):
        assert block.shape[0] == 100
        return np.convolve(block[:, 0], np.ones(11) / 11, mode="same")

    got = {r.frame_ix: r.score for r in dt.score_windows(f, seg, scorer).collect()}
    clip = np.array(vals[10:10 + n])
    tail = 25 + 50 - (n % 50 or 50)
    padded = np.concatenate([np.repeat(clip[:1], 25), clip, np.repeat(clip[-1:], tail)])[:, None]
    preds = np.concatenate([scorer(padded[s:s + 100])[25:75] for s in range(0, len(padded) - 99, 50)])[:n]
    assert sorted(got) == list(range(10, 10 + n))
    assert np.allclose([got[i] for i in range(10, 10 + n)], preds)


def test_ranges(spark):
    p = spark.createDataFrame([("c", i, e, 60) for i, e in enumerate([5, 5, 3, 20, 19, 70, 80])], "clip_id string, query_ix long, end_ix long, usable long")
    assert [(r.start_ix, r.end_ix) for r in dt.scan_ranges(p, ["clip_id"]).orderBy("query_ix").collect()] == [(0, 5), (5, 20), (20, 70)]


def test_hsv(spark):
    px = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 10, 10, 10])
    df = spark.createDataFrame([(px,)], "p binary")
    got = df.select(dt.hsv_features(2, 2)("p").alias("h")).first().h
    assert got == [0, 255, 255, 60, 255, 255, 120, 255, 255, 0, 0, 10]


def run_stream(spark, files, name, **kw):
    """Rows of each file arrive together; the files' order is that of arrival."""
    schema = "source_id string, frame_ix long, ts timestamp, feature double"
    src, ckpt = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    for rows in files[:1]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    q = (detect_cuts_stream(stream, 30.0, **kw).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", ckpt).start())
    try:
        q.processAllAvailable()
        for rows in files[1:]:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
        dropped = dropped_by_watermark(q)
    finally:
        q.stop()
    rows = spark.table(name).collect()
    return sorted((r.source_id, r.source_in, r.source_out) for r in rows if r.late is None), {r.source_id: r.late for r in rows if r.late}, dropped


def batch_shots(spark, rows, convention="last"):
    f = spark.createDataFrame(rows, "source_id string, frame_ix long, ts timestamp, feature double")
    seg = f.groupBy("source_id").agg(F.min("frame_ix").alias("source_in"), F.max("frame_ix").alias("source_out")).selectExpr(
        "'t' as timeline_id", "source_id as clip_id", "source_id", "source_in", "source_out")
    shots = dt.cuts_to_shots(dt.cuts_in_segments(dt.detect_cuts_diff(f, 30.0), seg), seg, convention)
    ends = {r.source_id: r.source_out for r in seg.collect()}
    return sorted((r.source_id, r.source_in, r.source_out) for r in shots.collect() if r.source_out != ends[r.source_id])


BASE = dt_.datetime(2024, 1, 1)


def second(i):
    return BASE + dt_.timedelta(seconds=i)


MARKERS = [[("end", j, BASE + dt_.timedelta(hours=j), 0.0)] for j in (1, 2)]


@pytest.mark.parametrize("convention", ["last", "first"])
def test_stream_equals_batch(spark, convention):
    """Holes in the numbers, also where a cut is; frames whose times run against their numbers; arrivals out of order; a busy source."""
    import random

    rnd, rows = random.Random(5), []
    for s, n, first in (("hot", 90, 0), ("b", 24, 7), ("c", 1, 3)):
        for i in range(first, first + n):
            if rnd.random() < 0.3 or i % 7 == 0:
                continue
            rows.append((s, i, second(i + rnd.randint(-2, 2)), float((i // 7 % 2) * 80 if s == "hot" else (i // 5 % 2) * 80)))
    order = sorted(rows, key=lambda r: (r[1] // 10, -r[1]))
    got, late, dropped = run_stream(spark, [order[k:k + 14] for k in range(0, len(order), 14)] + MARKERS, f"shots_{convention}", delay="30 seconds", convention=convention, disorder="5 seconds")
    assert got == batch_shots(spark, rows, convention) and len(got) > 8 and not late and not dropped


def test_late_frames_are_counted(spark):
    """A frame behind its settled successors is counted by the operator, one behind the watermark by the engine; neither changes a shot."""
    rows = [("s", i, second(i), float(i // 5 % 2 * 80)) for i in range(40) if i != 12]
    slow = [("s", 12, second(500), 999.0)]  # young, but all frames after it were compared
    old = [("s", 3, second(1), 999.0)]
    far = [("end", 0, second(60), 0.0)]
    got, late, dropped = run_stream(spark, [rows, far, slow, old, *MARKERS], "shots_late", delay="2 seconds")
    assert got == batch_shots(spark, rows) and late == {"s": 1} and dropped == 1


def test_stored_stream_resumes_and_vectors(spark):
    from shotweave.streaming.shots import detect_stored_stream

    schema = "source_id string, frame_ix long, ts timestamp, feature array<double>"
    rows = [("s", i, second(i), [float(i // 6 % 2 * 90)] * 3) for i in range(0, 60, 2)]
    src, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    stream = spark.readStream.schema(schema).parquet(src)
    for part in (rows[:15], rows[15:] + [("end", 0, second(1000), [0.0])]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        shots = detect_stored_stream(stream, out, delay="1 second")
    got = sorted((r.source_in, r.source_out) for r in shots.collect())
    want = batch_shots(spark, [(s, i, t, f[0]) for s, i, t, f in rows])
    assert got == [w[1:] for w in want] and len(got) > 5


def test_stream_state_is_written_once_a_call():
    """However many frames arrive, a call reads and writes the waiting ones once; of frames with one number the first counts."""
    from shotweave.streaming.shots import ShotProcessor

    class State:
        def __init__(self):
            self.value, self.writes = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def put(self, value):
            self.value, self.writes = list(value), self.writes + 1

        def clear(self):
            self.value = None

        update = put

    class Handle:
        def __init__(self):
            self.timers = []

        def getListState(self, *a):
            return State()

        getValueState = getListState

        def listTimers(self):
            return self.timers

        def registerTimer(self, t):
            self.timers.append(t)

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    p = ShotProcessor("double", 30.0, 10, 1)
    p.init(Handle())
    rows = pd.DataFrame({"frame_ix": [*range(500), 7], "ts": pd.to_datetime([*range(500), 7], unit="s"), "feature": [1.0] * 500 + [2.0]})
    list(p.handleInputRows(("s",), iter([rows]), Clock()))
    assert p.waiting.writes == 1 and [f[0] for f in p.waiting.value] == list(range(500)) and p.waiting.value[7][2] == 1.0


@pytest.mark.parametrize("kind", ["double", "binary", "array<array<double>>"])
def test_windows_cross_to_python_in_batches(spark, kind):
    """Many windows are rows of one plan step, not a group each; scalar, raw and nested features give the same scores."""
    made = {"double": lambda v: float(v), "binary": lambda v: bytes([v, v]), "array<array<double>>": lambda v: [[float(v)], [float(v)]]}[kind]
    f = spark.createDataFrame([("s", i, made((i * 37) % 251)) for i in range(160) if i % 9 != 4], f"source_id string, frame_ix long, feature {kind}")
    seg = spark.createDataFrame([("t", f"c{k}", "s", k, 150 + k) for k in range(8)], "timeline_id string, clip_id string, source_id string, source_in long, source_out long")
    out = dt.score_windows(f, seg)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.clip_id, r.frame_ix): r.score for r in out.collect()}
    value = lambda i: (i - 1 if i % 9 == 4 else i) * 37 % 251
    for k in (0, 7):
        want = {i: abs(value(min(i + 1, 150 + k)) - value(i)) / 255 for i in range(k, 151 + k)}
        assert {i: got[f"c{k}", i] for i in want} == pytest.approx(want)


def test_long_clips_are_counted_without_the_join(spark, tiny_chunks, monkeypatch):
    from shotweave.operators import ordered

    plans, count = [], ordered.long_keys

    def watched(df, keys):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return count(df, keys)

    for module in (ordered, dt):
        monkeypatch.setattr(module, "long_keys", watched)
    cuts = spark.createDataFrame([("t", "c", k) for k in (3, 5, 5, 9, 12, 40)], "timeline_id string, clip_id string, cut_frame long")
    seg = spark.createDataFrame([("t", "c", "s", 0, 20), ("t", "d", "s", 2, 4)], "timeline_id string, clip_id string, source_id string, source_in long, source_out long")
    got = [tuple(r) for r in dt.cuts_to_shots(cuts, seg).select("clip_id", "sub_ix", "source_in", "source_out").orderBy("clip_id", "sub_ix").collect()]
    assert got == [("c", 0, 0, 3), ("c", 1, 4, 5), ("c", 2, 6, 9), ("c", 3, 10, 12), ("c", 4, 13, 20), ("d", 0, 2, 4)]
    assert plans and not any("Join" in p for p in plans)
