"""Tracked lists as keyed state: one map of drugs for each user, with event-time eviction."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from oddspark import constants as K

_OUT = "user_id long, drug string, added_us long, as_of_us long"


class TrackedLists(StatefulProcessor):
    """The last action on a drug wins, whatever order rows come in; the list is cut by time of addition.

    Every batch that touches a user gives the user's whole list, stamped with the newest
    action; an empty list is one row without drug. A user without any action for
    ``idle_seconds`` of event time is forgotten, and given as empty.
    """

    def __init__(self, cap: int, idle_seconds: int):
        self.cap, self.idle_us = cap, idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        name = T.StructType([T.StructField("drug", T.StringType())])
        last = T.StructType([T.StructField("live", T.BooleanType()), T.StructField("us", T.LongType()), T.StructField("seq", T.LongType())])
        self.drugs = handle.getMapState("drugs", name, last)

    def _rows(self, user: int, live: list, as_of: int) -> pd.DataFrame:
        shown = live[: self.cap] or [(None, None)]
        out = pd.DataFrame({"user_id": [user] * len(shown), "drug": [d for _, d in shown], "added_us": [u for u, _ in shown], "as_of_us": [as_of] * len(shown)})
        return out.astype({"user_id": "int64", "drug": "object", "added_us": "Int64", "as_of_us": "int64"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for drug, action, us, seq in batch[["drug", "action", "us", "seq"]].itertuples(index=False):
                held = self.drugs.getValue((drug,))
                if held is None or (us, seq) > (held[1], held[2]):
                    self.drugs.updateValue((drug,), (action == "add", int(us), int(seq)))
        held = [(k[0], v[0], v[1]) for k, v in self.drugs.iterator()]
        newest = max(us for _, _, us in held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + self.idle_us) // 1000 + 1)
        yield self._rows(key[0], sorted((us, drug) for drug, live, us in held if live), newest)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.drugs.clear()
        yield self._rows(key[0], [], expiredTimerInfo.getExpiryTimeInMs() * 1000)

    def close(self) -> None:
        pass


def tracked_lists(events: DataFrame, cap: int = K.MAX_TRACKED, idle_seconds: int = 365 * 86400, late: str = "1 hour") -> DataFrame:
    """``user_id, drug, added_us, as_of_us`` from a stream ``(user_id, drug, action, at, seq)``; needs the RocksDB state store."""
    rows = events.withWatermark("at", late).select(
        F.col("user_id").cast("long").alias("user_id"), "drug", "action", F.unix_micros("at").alias("us"), F.col("seq").cast("long").alias("seq"), "at"
    )
    return rows.groupBy("user_id").transformWithStateInPandas(TrackedLists(cap, idle_seconds), _OUT, "Append", "EventTime")


def latest_lists(given: DataFrame) -> DataFrame:
    """``user_id, drug, added_at`` from everything the stream has given: of each user the newest list.

    Lists of the same stamp are one list that rows arriving late have changed; then the
    stream's output must carry the order of its batches in a column ``batch``.
    """
    order = F.struct(*[c for c in ("as_of_us", "batch") if c in given.columns])
    newest = F.max(order).over(Window.partitionBy("user_id"))
    rows = given.withColumn("_newest", newest).where((order == F.col("_newest")) & F.col("drug").isNotNull())
    return rows.select("user_id", "drug", F.timestamp_micros("added_us").alias("added_at"))
