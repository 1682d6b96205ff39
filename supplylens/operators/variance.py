"""Revenue change between two periods as volume, mix and price, which add up to it exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded
from supplylens.operators.clean import Core
from supplylens.operators.lookups import between
from supplylens.sources.standin import day

A, B = ("1999-01-01", "1999-12-31"), ("2000-01-01", "2000-12-31")


def by_sku(core: Core, group: str, a: tuple[str, str] = A, b: tuple[str, str] = B) -> DataFrame:
    """q, r and p of each (store, sku) in both periods, in one pass over the sales."""
    inside = lambda p: F.col("date").between(day(p[0]), day(p[1]))
    x = core.sales_enriched.where(inside(a) | inside(b))
    x = x.groupBy("store", "sku", "dept", F.col(group).alias("grp")).agg(
        *(F.sum(F.when(inside(p), F.col(c))).alias(f"{n}_{k}") for k, p in (("a", a), ("b", b)) for n, c in (("q", "units"), ("r", "revenue")))
    )
    days = core.raw.calendar().select("date", "week").join(core.fact_price_weekly.select("store", "dept", "week", "price"), "week")
    shelf = days.groupBy("store", "dept").agg(*(F.avg(F.when(inside(p), F.col("price"))).alias(f"shelf_{k}") for k, p in (("a", a), ("b", b))))
    x = x.join(shelf, ["store", "dept"], "left")
    own = lambda k: F.col(f"r_{k}") / F.nullif(F.col(f"q_{k}").cast("double"), F.lit(0.0))
    x = x.withColumn("p_a", F.coalesce(own("a"), "shelf_a", own("b"), "shelf_b", F.lit(0.0)))
    return x.fillna(0, ["q_a", "q_b"]).fillna(0.0, ["r_a", "r_b"])


def even(x):
    """Rounded to cents, half cents up whatever the order of the sum has left in the last bits."""
    return rounded(x + F.lit(1e-8))


def explain(x: DataFrame, keys: list[str]) -> DataFrame:
    g = x.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("q_a", "q_b", "r_a", "r_b")), F.sum(F.col("q_b") * F.col("p_a")).alias("s"))
    had = F.col("q_a") > 0
    avg = F.col("r_a") / F.nullif(F.col("q_a").cast("double"), F.lit(0.0))
    volume = F.when(had, (F.col("q_b") - F.col("q_a")) * avg).otherwise(F.col("s"))
    mix = F.when(had, F.col("s") - F.col("q_b") * avg).otherwise(F.lit(0.0))
    return g.select(
        *keys, F.col("q_a").cast("long").alias("units_a"), F.col("q_b").cast("long").alias("units_b"), rounded(F.col("r_a")).alias("revenue_a"), rounded(F.col("r_b")).alias("revenue_b"),
        even(volume).alias("volume"), even(mix).alias("mix"), even(F.col("r_b") - F.col("s")).alias("price"), even(F.col("r_b") - F.col("r_a")).alias("change"),
    )


def variance(core: Core, by: str) -> DataFrame:
    return explain(by_sku(core, by), ["grp"])


def totals(core: Core) -> DataFrame:
    """The sums of the departments' effects."""
    x = explain(by_sku(core, "dept"), ["grp"])
    return x.agg(*(rounded(F.sum(c)).alias(c) for c in ("volume", "mix", "price", "change")))


def driver(core: Core) -> DataFrame:
    """The largest effect of each department."""
    x = explain(by_sku(core, "dept"), ["grp"])
    effects = F.array(*(F.struct(F.abs(F.col(c)).alias("size"), F.lit(c).alias("name"), F.col(c).alias("effect")) for c in ("volume", "mix", "price")))
    best = F.array_max(effects)
    return x.select("grp", best["name"].alias("driver"), best["effect"].alias("effect"))


def pivoted(core: Core) -> DataFrame:
    """Units by department with a column for each period."""
    x = between(core.facts(), A[0], B[1])
    period = F.when(F.col("date") <= day(A[1]), "a").otherwise("b")
    return x.withColumn("period", period).groupBy("dept").pivot("period", ["a", "b"]).agg(F.sum("units").cast("long"))
