"""Timeouts of jobs and segments: a stream with a timer for each, and the same rule over a finished table.

A status holds until the next one of its key, or until its limit has passed: then the key gets the action of that limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds that a status may last, and what happens then. A segment that is being embedded waits again;
# jobs that are done, failed or stalled are removed.
LIMITS = {"embedding": (5 * 60, "waiting"), "completed": (24 * 3600, "removed"), "failed": (7 * 24 * 3600, "removed"), "active": (3600, "removed")}

OUTPUT = "id string, action string, status string, since timestamp, due timestamp"
#: What the state store of a stream with timers is kept in.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Timeouts(StatefulProcessor):
    """Keeps the last status of a key and one timer, at the end of its limit."""

    def __init__(self, limits: dict[str, tuple[int, str]]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, since long, due long")

    def _action(self, key: tuple, status: str, since: int, due: int) -> pd.DataFrame:
        moment = lambda ms: pd.Timestamp(ms, unit="ms")
        return pd.DataFrame([(key[0], self.limits[status][1], status, moment(since), moment(due))], columns=["id", "action", "status", "since", "due"])

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(["ts", "status"])
        last = self.last.get() if self.last.exists() else None
        for status, ts in zip(given["status"], given["ts"], strict=True):
            at = int(pd.Timestamp(ts).value // 1_000_000)
            if last is not None and at < last[1]:
                continue  # later news is known
            if last is not None and 0 <= last[2] < at:
                yield self._action(key, *last)  # its limit passed before this row
            limit = self.limits.get(status)
            last = (status, at, at + 1000 * limit[0] if limit else -1)
        self._forget()
        if last is not None:
            self.last.update(last)
            if last[2] >= 0:
                self.handle.registerTimer(last[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            last = self.last.get()
            if last[2] >= 0:
                yield self._action(key, *last)
        self.last.clear()

    def close(self) -> None:
        pass


def timed_out(events: DataFrame, limits: dict[str, tuple[int, str]] = LIMITS, late: str = "10 minutes") -> DataFrame:
    """id, action, status, since, due of each limit that passes in a stream of ``events`` (id, status, ts: timestamp).

    Time is event time: a limit has passed when a row of the key beyond it, or the watermark, says so. A row older than the last of its key is passed over.
    The session needs STORE as its state store.
    """
    rows = events.select(F.col("id").cast("string").alias("id"), "status", "ts").withWatermark("ts", late)
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=Timeouts(limits), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def timed_out_by(events: DataFrame, now: str, limits: dict[str, tuple[int, str]] = LIMITS) -> DataFrame:
    """The same over a finished table, as of ``now``: a limit that ended before the key's next row, or before ``now``."""
    rows = events.select(F.col("id").cast("string").alias("id"), "status", "ts").where("ts IS NOT NULL AND status IS NOT NULL")
    following = F.lead("ts").over(Window.partitionBy("id").orderBy("ts", "status"))
    seconds, action = F.lit(None).cast("int"), F.lit(None).cast("string")
    for status, (limit, what) in limits.items():
        seconds, action = F.when(F.col("status") == status, limit).otherwise(seconds), F.when(F.col("status") == status, what).otherwise(action)
    out = rows.withColumn("next", following).withColumn("due", F.col("ts") + F.make_interval(secs=seconds)).withColumn("action", action)
    return out.where(F.col("due") < F.coalesce("next", F.lit(now).cast("timestamp"))).select("id", "action", "status", F.col("ts").alias("since"), "due")
