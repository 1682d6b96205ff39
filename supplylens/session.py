"""Session settings for this engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.runSQLOnFiles": "false",
}


def build_session(master: str = "local[*]", partitions: int = 8, **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("supplylens").config("spark.sql.shuffle.partitions", partitions)
    return builder.config(map={**SETTINGS, **extra}).getOrCreate()
