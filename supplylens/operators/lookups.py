"""Lookups, totals, shares and rankings over the cleaned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded
from supplylens.functions.text import close_codes, normal_code
from supplylens.sources.standin import day

NEAREST = 5


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.col("date").between(day(start), day(end)))


def last_days(df: DataFrame, end: str, days: int, skip: int = 0) -> DataFrame:
    """Dates in (end - days, end - skip]: open on the left."""
    return df.where((F.col("date") > F.date_sub(day(end), days)) & (F.col("date") <= F.date_sub(day(end), skip)))


def total(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(rounded(F.sum(value)).alias(name))


def top_k(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The first k by value, ties by key; tied_at_cut if the next one has the value of the last.

    Only k + 1 rows leave the sort, so the window sees no more.
    """
    first = df.orderBy(F.desc(value), F.asc(key)).limit(k + 1)
    w = Window.orderBy(F.desc(value), F.asc(key))
    ranked = first.select("*", F.row_number().over(w).cast("long").alias("rank"), F.lead(value).over(w).alias("next"))
    return ranked.where(F.col("rank") <= k).withColumn("tied_at_cut", (F.col("rank") == k) & F.col("next").eqNullSafe(F.col(value))).drop("next")


def share(df: DataFrame, whole: list[str], part: str, value: str) -> DataFrame:
    parts = df.groupBy(*whole, part).agg(F.sum(value).alias("v"))
    wholes = df.groupBy(*whole).agg(F.sum(value).alias("all"))
    return parts.join(wholes, whole).select(*whole, part, rounded(100 * F.col("v") / F.nullif(F.col("all"), F.lit(0.0)), 4).alias("share_pct"))


def change(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Change in per cent against the period before; null where that has no value."""
    sums = df.groupBy(*keys, period).agg(F.sum(value).alias("now"))
    prior = sums.select(*keys, (F.col(period) + 1).alias(period), F.col("now").alias("prior"))
    pct = 100 * (F.col("now") - F.col("prior")) / F.nullif(F.col("prior"), F.lit(0))
    return sums.join(prior, [*keys, period], "left").select(*keys, period, "now", "prior", rounded(pct.cast("double"), 4).alias("change_pct"))


def truncated(df: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows, and whether there are more: one row beyond is asked for."""
    rows = df.limit(limit + 1)
    return rows.agg(F.least(F.count("*"), F.lit(limit)).alias("n_rows"), (F.count("*") > limit).alias("truncated"))


def spelled(codes: DataFrame, skus: DataFrame, code: str = "code") -> DataFrame:
    """Each spelling of a code with the SKU that it stands for (null: none), and whether it had to be interpreted."""
    known = skus.select("sku", F.col("sku").alias("_sku"))
    x = codes.withColumn("_sku", normal_code(F.col(code))).join(known, "_sku", "left").drop("_sku")
    return x.withColumn("interpreted", F.col("sku").isNotNull() & (F.col(code) != F.col("sku")))


def resolve(skus: DataFrame, code: str) -> tuple[str, list[str]]:
    """The SKU that a spelling stands for and what was made of it; ValueError with the nearest codes if there is none."""
    if not code or not code.strip():
        raise ValueError("a SKU is needed")
    found = spelled(skus.sparkSession.createDataFrame([(code,)], "code string"), skus).first()
    if found["sku"] is None:
        normal = code.strip().upper().replace("-", "_").replace(" ", "_")
        near = [r["sku"] for r in close_codes(skus, "sku", normal, NEAREST).collect()]
        raise ValueError(f"unknown SKU {code!r}; the nearest are {', '.join(near)}")
    return found["sku"], [f"SKU {code!r} was read as {found['sku']}."] if found["interpreted"] else []
