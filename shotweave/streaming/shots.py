"""Shot detection over an arriving frame stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shotweave.operators.detect import DIFF_THRESHOLD

#: Session setting that keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ShotProcessor(StatefulProcessor):
    """Frames of one source, in frame order as far as the watermark allows, into closed shots.

    State: the frames still waiting, as one list that is read and written once a call, whatever their number; and the last settled frame with the open shot's start. A frame is settled once the watermark has passed
    its time by ``hold_ms``: then no frame of a lower number can come any more. All waiting frames up to the highest settled one are compared, each with the
    one before it that is really there, so holes in the numbers lose no cut. A timer brings the next frames to their turn without new input.
    """

    def __init__(self, feature_type: str, threshold: float, hold_ms: int, shift: int):
        self.feature_type, self.threshold, self.hold_ms, self.shift = feature_type, threshold, hold_ms, shift

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"frame_ix bigint, at bigint, feature {self.feature_type}")
        # bound: a cut whose shot ends with the cut's own frame, as long as no later frame is settled
        self.open = handle.getValueState("open", f"last_ix bigint, feature {self.feature_type}, start bigint, bound bigint")

    def _plain(self, v):
        return [float(x) for x in v] if self.feature_type.startswith("array") else float(v)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.open.get()[0] if self.open.exists() else None
        late, new = 0, []
        for pdf in rows:
            for ix, ts, feature in zip(pdf["frame_ix"], pdf["ts"], pdf["feature"], strict=True):
                if last is not None and ix <= last:
                    late += 1
                elif feature is not None:
                    new.append((int(ix), int(pd.Timestamp(ts).value // 1_000_000), self._plain(feature)))
        yield self._settle(key, timerValues, late, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key, timerValues, 0, [])

    def _settle(self, key, timerValues, late: int, new: list[tuple]) -> pd.DataFrame:
        mark = timerValues.getCurrentWatermarkInMs()
        by_number: dict[int, tuple] = {}
        for f in [*(self.waiting.get() if self.waiting.exists() else []), *new]:
            by_number.setdefault(f[0], tuple(f))  # of frames with one number the first that came counts
        frames = [by_number[ix] for ix in sorted(by_number)]
        upto = max((ix for ix, at, _ in frames if at + self.hold_ms < mark), default=None)
        out = [(key[0], None, None, late)] if late else []
        if upto is not None:
            before, feature, start, bound = self.open.get() if self.open.exists() else (None, None, None, None)
            for ix, _, f in frames:
                if ix > upto:
                    break
                if start is None:
                    start = ix
                if bound is not None:  # this frame is beyond the cut's, so the shot is closed
                    out.append((key[0], start, bound - 1, None))
                    start, bound = bound, None
                if before is not None and self._differs(feature, f):
                    b = ix + self.shift
                    if self.shift:
                        bound = b
                    elif b > start:
                        out.append((key[0], start, b - 1, None))
                        start = b
                before, feature = ix, f
            self.open.update((before, feature, start, bound))
        left = [f for f in frames if upto is None or f[0] > upto]
        if not left:
            self.waiting.clear()
        elif new or upto is not None:
            self.waiting.put(left)
        if left:
            due = max(min(at for _, at, _ in left) + self.hold_ms, mark) + 1
            if due not in set(self.handle.listTimers()):
                self.handle.registerTimer(due)
        return pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=t) for k, (c, t) in enumerate(
            [("source_id", "object"), ("source_in", "Int64"), ("source_out", "Int64"), ("late", "Int64")])})

    def _differs(self, a, b) -> bool:
        gap = float(np.mean(np.abs(np.subtract(a, b))))
        return gap > self.threshold

    def close(self) -> None:
        pass


def detect_cuts_stream(frames: DataFrame, threshold: float = DIFF_THRESHOLD, delay: str = "10 minutes", convention: str = "last",
                       disorder: str | None = None) -> DataFrame:
    """Closed shots (source_id, source_in, source_out, late) of a frame stream (source_id, frame_ix, ts, feature).

    Equals difference detection over the whole table on all frames that are settled, holes in the numbers included; the first shot starts at the source's first
    frame and the last stays open. Frames may arrive in any order within ``delay`` of event time, and a frame may be up to ``disorder`` (``delay`` unless
    given) younger than one with a higher number. A frame that comes after its successors were compared is not used: rows with ``late`` count such frames, the
    other columns are null there. Frames behind the watermark never reach the operator; ``dropped_by_watermark`` counts those. Repeated numbers count
    once; frames without a feature make no cut. State per source is the frames of that time span, in the RocksDB store (``STATE_STORE``).
    """
    kind = next(f.dataType.simpleString() for f in frames.schema if f.name == "feature")
    kind = "array<double>" if kind.startswith("array") else "double"
    sid = next(f.dataType.simpleString() for f in frames.schema if f.name == "source_id")
    hold = int(pd.Timedelta(disorder if disorder is not None else delay).value // 1_000_000)
    rows = frames.select("source_id", F.col("frame_ix").cast("long").alias("frame_ix"), "ts", F.col("feature").cast(kind).alias("feature")).withWatermark("ts", delay)
    return rows.groupBy("source_id").transformWithStateInPandas(
        ShotProcessor(kind, threshold, hold, 1 if convention == "last" else 0), f"source_id {sid}, source_in bigint, source_out bigint, late bigint", "Append", "EventTime")


def dropped_by_watermark(query) -> int:
    """Frames that a running or finished query dropped because they came behind the watermark."""
    return sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for o in p["stateOperators"])


def detect_stored_stream(frames: DataFrame, folder: str, threshold: float = DIFF_THRESHOLD, delay: str = "10 minutes", convention: str = "last",
                         disorder: str | None = None) -> DataFrame:
    """Runs the stream over all that a streaming ``frames`` has now, with its checkpoint and its result in ``folder``, and reads the result."""
    spark = frames.sparkSession
    if not spark.conf.get(STATE_STORE[0], "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(*STATE_STORE)
    out = detect_cuts_stream(frames, threshold, delay, convention, disorder)
    query = (out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/shots")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/shots")
