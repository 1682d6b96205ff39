"""Stock and sales anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded
from supplylens.operators.clean import Core
from supplylens.operators.lookups import last_days
from supplylens.operators.relational import latest
from supplylens.sources.standin import AS_OF, day

OVERSTOCK_DAYS, OVERSTOCK_KEEP, DEAD_UNITS = 90, 30, 24


def inventory_anomalies(core: Core, end: str = AS_OF, window: int = 28) -> DataFrame:
    """stockout, stockout_risk, overstock and dead_stock of active SKUs, with their value; a day's
    sales are the units of `window` days by the days on which the store was open."""
    units = last_days(core.fact_sales_daily, end, window).groupBy("store", "sku").agg(F.sum("units").alias("u"))
    days = last_days(core.store_day_status, end, window).where("status = 'open'").groupBy("store").agg(F.count("*").alias("open_days"))
    price = latest(core.fact_price_weekly, ["store", "dept"], "week", ["price"]).drop("week")
    sku = core.dim_sku.where("status = 'ACTIVE'").select("sku", "dept", "unit_cost", "supplier_id")
    x = core.inventory.join(sku.join(core.raw.suppliers().select("supplier_id", "lead_time_days"), "supplier_id"), "sku")  # by SKU: stock is shuffled once less
    x = x.join(units, ["store", "sku"], "left").join(days, "store", "left").join(price, ["store", "dept"], "left")
    avg = F.coalesce(F.col("u"), F.lit(0)).cast("double") / F.nullif(F.col("open_days").cast("double"), F.lit(0.0))
    x = x.withColumn("avg_daily", avg)
    a, lead, hand, order = F.col("avg_daily"), F.col("lead_time_days"), F.col("on_hand"), F.col("on_order")
    per_day = F.nullif(a, F.lit(0.0))
    kind = (
        F.when((hand == 0) & (a > 0), "stockout")
        .when((hand + order) / per_day < lead, "stockout_risk")
        .when(hand / per_day > OVERSTOCK_DAYS, "overstock")
        .when((a == 0) & (hand >= DEAD_UNITS), "dead_stock")
    )
    value = (
        F.when(F.col("anomaly") == "stockout", a * lead * F.col("price"))
        .when(F.col("anomaly") == "stockout_risk", (a * lead - hand - order) * F.col("price"))
        .when(F.col("anomaly") == "overstock", (hand - OVERSTOCK_KEEP * a) * F.col("unit_cost"))
        .otherwise(hand * F.col("unit_cost"))
    )
    x = x.withColumn("anomaly", kind).where("anomaly IS NOT NULL")
    return x.select("store", "sku", "dept", "anomaly", "on_hand", "on_order", rounded(a, 4).alias("avg_daily"), rounded(hand / per_day, 4).alias("days_of_cover"), "lead_time_days", rounded(value).alias("value"))


def week_anomalies(core: Core, end: str = AS_OF, blocks: int = 9, least: int = 3, change: float = 0.25, spread: float = 2.0) -> DataFrame:
    """Weeks back from `end`, by store and department, against the weeks before; weeks that touch a
    day without data are left out. No spread in the baseline gives no z and no row."""
    sales = last_days(core.sales_enriched, end, 7 * blocks).withColumn("block", F.floor(F.datediff(day(end), F.col("date")) / 7).cast("int"))
    lost = last_days(core.store_day_status, end, 7 * blocks).where("status = 'missing_data'")
    lost = lost.select("store", F.floor(F.datediff(day(end), F.col("date")) / 7).cast("int").alias("block")).distinct()
    weeks = sales.groupBy("store", "dept", "block").agg(F.sum("units").alias("u")).join(lost, ["store", "block"], "left_anti")
    base = F.col("block") > 0
    x = weeks.groupBy("store", "dept").agg(
        F.sum(F.when(~base, F.col("u"))).alias("this_week"),
        F.avg(F.when(base, F.col("u"))).alias("base_mean"),
        F.stddev_samp(F.when(base, F.col("u"))).alias("sd"),
        F.count(F.when(base, F.col("u"))).alias("n"),
    )
    diff = F.col("this_week") - F.col("base_mean")
    x = x.withColumns({"pct_change": diff / F.nullif(F.col("base_mean"), F.lit(0.0)), "z": diff / F.nullif(F.col("sd"), F.lit(0.0))})
    hit = x.where((F.col("n") >= least) & (F.abs("pct_change") > change) & (F.abs("z") > spread))
    kind = F.when(F.col("pct_change") > 0, "sales_spike").otherwise("sales_drop")
    return hit.select("store", F.col("dept").alias("subject"), F.lit("dept").alias("level"), kind.alias("anomaly"), "this_week", rounded(F.col("base_mean"), 4).alias("base_mean"), rounded(F.col("pct_change"), 4).alias("pct_change"), rounded(F.col("z"), 4).alias("z"))


def sku_anomalies(core: Core, end: str = AS_OF, scale: int = 1, stopped: float = 1.5, spike: int = 20) -> DataFrame:
    """SKUs whose sales stopped or spiked; `scale` stretches the windows of 7, 14 and 42 days."""
    d, u = F.col("date"), F.col("units")
    after = lambda n: d > F.date_sub(day(end), n * scale)
    x = last_days(core.fact_sales_daily, end, 42 * scale).groupBy("store", "sku").agg(
        F.sum(F.when(after(14), u)).alias("last14"), (F.sum(F.when(~after(14), u)).cast("double") / (28.0 * scale)).alias("base_daily"), F.sum(F.when(after(7), u)).alias("last7")
    )
    week = 7.0 * scale
    gone = (F.coalesce("last14", F.lit(0)) == 0) & (F.col("base_daily") >= stopped)
    up = (F.coalesce("last7", F.lit(0)) >= spike) & (F.coalesce("last7", F.lit(0)) > 4 * F.col("base_daily") * week)
    now = F.coalesce("last7", F.lit(0))
    base = F.col("base_daily") * week
    kind = F.when(F.coalesce("last14", F.lit(0)) == 0, "sales_stopped").otherwise("sku_spike")
    return x.where(gone | up).select("store", F.col("sku").alias("subject"), F.lit("sku").alias("level"), kind.alias("anomaly"), now.alias("this_week"), rounded(base, 4).alias("base_mean"), rounded((now - base) / base, 4).alias("pct_change"), F.lit(None).cast("double").alias("z"))


def sales_anomalies(core: Core, end: str = AS_OF, scale: int = 1, stopped: float = 1.5) -> DataFrame:
    return week_anomalies(core, end).unionByName(sku_anomalies(core, end, scale, stopped), allowMissingColumns=True)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("anomaly").agg(F.count("*").alias("n"), rounded(F.sum("value"), 0).alias("value"))
