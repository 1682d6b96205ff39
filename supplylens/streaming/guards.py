"""Limits on use: a sliding limit for each user and a budget for each UTC day, as batches and as streams.

The limiter lets an attempt pass when fewer than `most` attempts of its user have passed in the window
before it; attempts that are turned down don't count. The budget lets a turn begin while what the turns
of its day have cost so far is below the limit, so the last one may go over it.

Streams keep their state in the checkpoint: of a user the times of at most `most` attempts, of a day what has been
spent. Timers drop the state of users who have been idle for a window and of days that are over. Events that
come after the watermark are not decided.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

WINDOW, MOST, BUDGET, LATE = 3600, 3, 5000.0, "10 minutes"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIMITED = "event_id long, user_id long, ts long, allowed boolean, wait double"
SPENT = "event_id long, day string, spent_before double, allowed boolean"


def decide(held: list[int], now: int, most: int, window: int) -> tuple[bool, float, list[int]]:
    """Whether an attempt at `now` (microseconds) passes, the seconds until one would, and the times held after it."""
    held = [t for t in held if now - t < window * 1_000_000]
    if len(held) >= most:
        return False, window - (now - held[0]) / 1e6, held
    return True, 0.0, [*held, now]


def _attempts(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))


def _parts(x: DataFrame, gap: int) -> DataFrame:
    """With `part`, the time at which a user's run of attempts began that are less than a gap apart.

    Hours come first, each with its own window, then the hours of a user: no window holds all attempts of a user.
    """
    hour, own = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("hour")
    x = x.withColumn("hour", F.expr("ts div 3600000000"))
    last = x.groupBy("user_id", "hour").agg(F.max("ts").alias("last")).select("user_id", "hour", F.lag("last").over(own).alias("before"))
    x = x.join(last, ["user_id", "hour"]).withColumn("prior", F.coalesce(F.lag("ts").over(hour), "before"))
    begun = F.when(F.col("prior").isNull() | (F.col("ts") - F.col("prior") >= gap), F.col("ts"))
    x = x.withColumn("begun", begun)
    carried = x.groupBy("user_id", "hour").agg(F.max("begun").alias("b")).select("user_id", "hour", F.last("b", True).over(own.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    x = x.withColumn("part", F.last("begun", True).over(hour.rowsBetween(Window.unboundedPreceding, 0)))
    return x.join(carried, ["user_id", "hour"]).withColumn("part", F.coalesce("part", "carried")).select("event_id", "user_id", "ts", "part")


def limited(events: DataFrame, most: int = MOST, window: int = WINDOW) -> DataFrame:
    """event_id, user_id, ts, allowed, wait of each attempt of a batch.

    An attempt that comes a window or more after its user's last one finds nothing held, so a user's
    attempts are cut there and the parts go to tasks of their own, each read in order with `most` times in memory.
    """
    x = _parts(_attempts(events), window * 1_000_000).repartition("user_id", "part").sortWithinPartitions("user_id", "part", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            said = []
            for key, now in zip(zip(b["user_id"].tolist(), b["part"].tolist(), strict=True), b["ts"].tolist(), strict=True):
                if key != at:
                    at, held = key, []
                allowed, wait, held = decide(held, now, most, window)
                said.append((allowed, wait))
            yield b[["event_id", "user_id", "ts"]].assign(allowed=[s[0] for s in said], wait=[s[1] for s in said])

    return x.mapInPandas(run, LIMITED)


def budgeted(events: DataFrame, limit: float = BUDGET, cost: str = "value") -> DataFrame:
    """event_id, day, spent_before and allowed of each turn of a batch.

    What a day has cost before a turn is what its earlier minutes have cost, and the earlier turns of its minute:
    no window holds more than a minute's turns or a day's minutes. Turns that are not allowed may be counted in,
    since before them the limit is reached already; what is shown stops at the first one's.
    """
    cents = F.greatest(F.coalesce(F.round(F.col(cost) * 100), F.lit(0.0)), F.lit(0.0)).cast("long")
    x = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), cents.alias("cents"))
    x = x.withColumns({"day": F.col("ts").cast("date").cast("string"), "minute": F.date_trunc("minute", "ts")})
    before = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = x.groupBy("day", "minute").agg(F.sum("cents").alias("sum")).select("day", "minute", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("day", "minute").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("own", F.coalesce(F.sum("cents").over(own), F.lit(0))).join(minutes, ["day", "minute"])
    spent, most = F.col("own") + F.col("earlier"), F.lit(round(limit * 100))
    return x.select("event_id", "day", (spent / F.lit(100.0)).alias("spent_before"), (spent < most).alias("allowed"))


class Limiter(StatefulProcessor):
    """The times of a user's last attempts that passed."""

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", StructType([StructField("ts", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = sorted(r[0] for r in self.held.get())
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            allowed, wait, held = decide(held, r.ts, self.most, self.window)
            yield Row(event_id=r.event_id, user_id=r.user_id, ts=r.ts, allowed=allowed, wait=wait)
        self.held.put([(t,) for t in held])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(held, default=0) // 1000 + self.window * 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class Budget(StatefulProcessor):
    """What a day has cost so far."""

    def __init__(self, limit: float):
        self.most = round(limit * 100)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", StructType([StructField("cents", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        spent = self.spent.get()[0] if self.spent.exists() else 0
        if not self.spent.exists():
            self.handle.registerTimer(int(pd.Timestamp(key[0], tz="UTC").timestamp() * 1000) + 86_400_000)
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            yield Row(event_id=r.event_id, day=r.day, spent_before=spent / 100.0, allowed=spent < self.most)
            spent += r.cents
        self.spent.update((spent,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.spent.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, most: int = MOST, window: int = WINDOW) -> DataFrame:
    """The same for a stream, in the order in which its batches bring the attempts."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    x = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)
    x = x.select("event_id", "user_id", F.unix_micros("at").alias("ts"), "at")
    return x.groupBy("user_id").transformWithState(Limiter(most, window), LIMITED, "Append", "EventTime")


def budgeted_stream(events: DataFrame, limit: float = BUDGET, cost: str = "value") -> DataFrame:
    """The same for a stream; all turns of a day meet in one state, as the budget asks."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    cents = F.greatest(F.coalesce(F.round(F.col(cost) * 100), F.lit(0.0)), F.lit(0.0)).cast("long")
    x = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)
    x = x.select("event_id", F.col("at").cast("date").cast("string").alias("day"), cents.alias("cents"), F.unix_micros("at").alias("ts"), "at")
    return x.groupBy("day").transformWithState(Budget(limit), SPENT, "Append", "EventTime")
