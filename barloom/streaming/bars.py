"""Streaming extras: event-time bars with late data, and indicators that carry their state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.resume import INDICATORS, RAW, State, advance

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PARTS = "n long, high array<double>, low array<double>, close array<double>, carried array<double>"


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_bars(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """First, highest, lowest, last value and count for each event type and window; rows later than the watermark are dropped."""
    window = F.window("ts", every)
    bars = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window, "event_type").agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("n"),
    )
    return bars.select(F.col("window.start").alias("start"), "event_type", "open", "high", "low", "close", "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    found = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


class RunningIndicators(StatefulProcessor):
    """Bars of one instrument wait in a list until the watermark has passed them, then go through the fold in order of event time.

    The fold's state is a value state; a timer at each bar's time lets it go. So a bar that comes late, but within the
    watermark's delay, takes its place as if it had come in time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE_PARTS)
        self.held = handle.getListState("held", "at long, trade_date string, high double, low double, close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            at = frame["at"].astype("int64").tolist()
            self.held.appendList(list(zip(at, frame["trade_date"].tolist(), *(frame[c].astype(float).tolist() for c in ("high", "low", "close")))))
            for t in set(at):
                self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(tuple(r) for r in self.held.get())
        ready, later = [r for r in held if r[0] <= upto], [r for r in held if r[0] > upto]
        if not ready:  # an earlier timer of the same batch took them along
            return
        if later:
            self.held.put(later)
        else:
            self.held.clear()
        known = self.state.get() if self.state.exists() else None
        before = State() if known is None else State(int(known[0]), *(np.array(x, float) for x in known[1:4]), np.array(known[4], float) if known[4] is not None else None)
        out, after = advance(before, *(np.array([r[i] for r in ready], float) for i in (2, 3, 4)))
        self.state.update((after.n, *(getattr(after, c).tolist() for c in ("high", "low", "close")), None if after.carried is None else after.carried.tolist()))
        yield pd.DataFrame({"ts_code": key[0], "trade_date": [r[1] for r in ready], "pos": np.arange(before.n, after.n), **{c: out[c] for c in INDICATORS}})

    def close(self) -> None:
        pass


def running_indicators(bars: DataFrame, late: str = "5 days") -> DataFrame:
    """All indicators of a stream of bars (ts_code, trade_date, ts as event time, high, low, close; one bar a date), in unadjusted prices.

    A bar comes out once the watermark has passed it, with the columns of ``resume.RAW``; bars behind the watermark are
    dropped. The fold is that of the stored indicators, so a stream and a batch over the same bars agree. Needs the
    state store of RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    timed = bars.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    timed = timed.select("ts_code", "trade_date", "high", "low", "close", F.unix_millis("ts").alias("at"), "ts")
    return timed.groupBy("ts_code").transformWithStateInPandas(RunningIndicators(), RAW, "append", "eventTime")
