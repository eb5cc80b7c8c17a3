"""Streams of recordings: runs by a fixed gap, count windows in keyed state, and count windows in time order with state that expires.

The batch plan's gap is a multiple of a whole group's median and its filling looks ahead;
a stream can do neither, so the gap is given and rows with nulls are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_runs(events: DataFrame, gap: str, late: str, keys: tuple[str, ...] = ("user_id", "event_type")) -> DataFrame:
    """Closed runs with rows, start, end and mean value; rows later than the watermark are dropped."""
    run = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(*keys, run).agg(F.count("*").alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.avg("value").alias("mean_value"))
    return out.drop("session_window")


def stream_windows(events: DataFrame, size: int, stride: int, gap_seconds: float) -> DataFrame:
    """Count windows of each (user_id, event_type): start_ts, end_ts, mean, min, max; state holds at most size rows a key."""
    out = "user_id long, event_type string, start_ts double, end_ts double, mean double, min double, max double"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, values, wait = state.get if state.exists else ([], [], 0)
        ts, values = list(ts), list(values)
        rows = pd.concat(list(batches)).sort_values("t")
        found = []
        for t, v in zip(rows["t"], rows["value"], strict=True):
            if ts and (t <= ts[-1] or t - ts[-1] > gap_seconds):
                ts, values, wait = [], [], 0
            ts.append(float(t))
            values.append(float(v))
            if wait:
                wait -= 1
            if len(ts) > size:
                ts, values = ts[-size:], values[-size:]
            if len(ts) == size and not wait:
                found.append((*key, ts[0], ts[-1], sum(values) / size, min(values), max(values)))
                wait = stride
        state.update((ts, values, wait))
        if found:
            yield pd.DataFrame(found, columns=["user_id", "event_type", "start_ts", "end_ts", "mean", "min", "max"])

    timed = events.where("value is not null").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).select("user_id", "event_type", "t", "value")
    return timed.groupBy("user_id", "event_type").applyInPandasWithState(run, out, "ts array<double>, v array<double>, wait int", "append", GroupStateTimeout.NoTimeout)


class OrderedWindows(StatefulProcessor):
    """Count windows of one key in the order of event time, whatever the order of arrival within the watermark.

    Rows wait until the watermark has passed them, then go through the open run in order. A timer at the last row's
    time and the gap ends the run and clears the key's state: a row after that would begin a new run anyway.
    State holds the waiting rows and at most size rows of the run.
    """

    def __init__(self, size: int, stride: int, gap_seconds: float) -> None:
        self.size, self.stride, self.gap = size, stride, gap_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, v double")
        self.run = handle.getValueState("run", "ts array<double>, v array<double>, wait int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        new = [(float(t), float(v)) for pdf in rows for t, v in zip(pdf["t"], pdf["value"], strict=True) if t > passed]
        if new:
            self.waiting.appendList(new)
            for at in {math.ceil(t * 1000) for t, _ in new}:
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in waiting if r[0] <= passed], [r for r in waiting if r[0] > passed]
        ts, values, wait = self.run.get() if self.run.exists() else ([], [], 0)
        ts, values, found = list(ts), list(values), []
        for t, v in due:
            if ts and (t <= ts[-1] or t - ts[-1] > self.gap):
                ts, values, wait = [], [], 0
            ts, values, wait = [*ts, t][-self.size :], [*values, v][-self.size :], max(wait - 1, 0)
            if len(ts) == self.size and not wait:
                found.append((*key, ts[0], ts[-1], sum(values) / self.size, min(values), max(values)))
                wait = self.stride
        self.waiting.clear()
        if later:
            self.waiting.appendList(later)
        over = bool(ts) and ts[-1] + self.gap < passed
        if over or not ts:
            self.run.clear()
        else:
            self.run.update((ts, values, wait))
            if due:
                self.handle.registerTimer(math.floor((ts[-1] + self.gap) * 1000) + 1)
        if found:
            yield pd.DataFrame(found, columns=WINDOW_COLUMNS)

    def close(self) -> None:
        pass


WINDOW_COLUMNS = ["user_id", "event_type", "start_ts", "end_ts", "mean", "min", "max"]


def stream_ordered_windows(events: DataFrame, size: int, stride: int, gap_seconds: float, late: str) -> DataFrame:
    """`stream_windows` in event-time order: rows may arrive out of order up to `late`, later ones are dropped, idle keys leave no state.

    Of rows of one key with one time each begins a run of its own, by value. The session's state store must be RocksDB
    (spark.sql.streaming.stateStore.providerClass), which keyed state with timers needs.
    """
    timed = events.where("value is not null").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withWatermark("ts", late).select("user_id", "event_type", "ts", "t", "value")
    out = "user_id long, event_type string, start_ts double, end_ts double, mean double, min double, max double"
    return timed.groupBy("user_id", "event_type").transformWithStateInPandas(OrderedWindows(size, stride, gap_seconds), out, "append", "EventTime")
