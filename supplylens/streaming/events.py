"""Event windows. Each function takes a batch frame or a stream; streams get a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded

LATE = "10 minutes"


def _watched(events: DataFrame) -> DataFrame:
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return x.withWatermark("ts", LATE) if events.isStreaming else x


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    x = _watched(events).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), rounded(F.sum("value")).alias("value"))
    return x.select(F.col("w.start").cast("string").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    x = _watched(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return x.select("user_id", F.col("w.start").cast("string").alias("start"), "n")


def over_limit(events: DataFrame, seconds: int = 3600, most: int = 1) -> DataFrame:
    """Events that come when their user has had `most` or more in the seconds before: batch only, a
    window over each user's own events."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(micros).rangeBetween(-seconds * 1_000_000, -1)
    return events.withColumn("before", F.count("*").over(w)).where(F.col("before") >= most).select("event_id", "user_id", "before")


def once_per_file(loads: DataFrame) -> DataFrame:
    """The first load of each file within the watermark."""
    x = loads.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    return x.withWatermark("loaded_at", "7 days").dropDuplicatesWithinWatermark(["source_file"]) if loads.isStreaming else x.dropDuplicates(["source_file"])
