"""Streaming twins of the usage aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def daily_counters(events: DataFrame, ts: str = "ts", metric: str = "event_type", late: str = "1 day") -> DataFrame:
    """Counts per day and metric; rows later than the watermark are dropped, state is evicted with it."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day"), F.col(metric).alias("metric"))
        .agg(F.count(F.lit(1)).alias("value"))
        .select(F.to_date("window.start").alias("day"), "metric", "value")
    )


def unmatched_backlog(log: DataFrame, ts: str = "created_at", late: str = "1 day") -> DataFrame:
    """Searches per day that matched nothing."""
    return (
        log.where(F.col("matched_drug").isNull())
        .withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day"), F.lower("drug_query").alias("term"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("window.start").alias("day"), "term", "n")
    )


def sliding_rate(requests: DataFrame, client: str, ts: str, length: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Requests per client in sliding windows."""
    return (
        requests.withWatermark(ts, length)
        .groupBy(client, F.window(ts, length, slide))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(client, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "requests")
    )


def sessions(log: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return (
        log.withWatermark(ts, late)
        .groupBy(user, F.session_window(ts, gap))
        .agg(F.count(F.lit(1)).alias("searches"))
        .select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "searches")
    )


class TrailingRate(StatefulProcessor):
    """Exact trailing-window count per client, also for late rows; keys idle for a whole window are dropped by a timer.

    A late row counts what came before it; counts that were already given are not taken back.
    """

    def __init__(self, seconds: int, limit: int):
        self.length_us = seconds * 1_000_000
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = np.sort(pd.concat(list(rows), ignore_index=True)["us"].to_numpy(np.int64))
        seen = np.array([r[0] for r in self.recent.get()] if self.recent.exists() else [], np.int64)
        stamps = np.sort(np.concatenate((seen, fresh)))
        counts = np.searchsorted(stamps, fresh, side="right") - np.searchsorted(stamps, fresh - self.length_us, side="left")
        # a row as late as the watermark allows still needs the window before it
        oldest = min(timerValues.getCurrentWatermarkInMs() * 1000, int(stamps[-1])) - self.length_us
        keep = stamps[stamps >= oldest]
        self.recent.put([(int(t),) for t in keep])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(keep[-1]) + self.length_us) // 1000 + 1)
        yield pd.DataFrame({"client": [key[0]] * len(fresh), "us": fresh, "in_window": counts, "limited": counts >= self.limit})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        yield pd.DataFrame({"client": [], "us": [], "in_window": [], "limited": []}).astype(
            {"client": "int64", "us": "int64", "in_window": "int64", "limited": "bool"}
        )

    def close(self) -> None:
        pass


def trailing_rate(requests: DataFrame, client: str, ts: str, seconds: int, limit: int, late: str = "1 minute") -> DataFrame:
    """Stateful twin of the batch rolling rate (needs the RocksDB state store)."""
    rows = requests.withWatermark(ts, late).select(
        F.col(client).cast("long").alias("client"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), ts
    )
    return rows.groupBy("client").transformWithStateInPandas(
        TrailingRate(seconds, limit), "client long, us long, in_window long, limited boolean", "Append", "EventTime"
    )
