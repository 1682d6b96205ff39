"""Raw retail exports made from the star-schema tables, with known faults put in.

Every fault is set by integer arithmetic on keys and dates, so that another engine can make the same
rows. Stores are regions, SKUs are parts, departments are part types and categories are brands.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded
from supplylens.sources.store import store

EPOCH, AS_OF = "1995-01-01", "2001-06-30"
ALIAS_FROM = "1999-01-01"
CASE_STORE, CASE_FROM, CASE_TO = "EUROPE", "2000-02-01", "2000-03-31"
OUTAGE_STORE, OUTAGE_DAYS = "AFRICA", ("2000-05-10", "2000-05-11")
CLOSURE = "1999-12-25"
TWICE_STORE, TWICE_WEEK, TWICE_STEP = "ASIA", 300, 1_000_000
TASK_ROWS = 250_000


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def week_of(date: Column) -> Column:
    return F.floor(F.datediff(date, day(EPOCH)) / 7).cast("int")


def sku_of(dept: str, part_no: str) -> Column:
    return F.concat(F.upper(dept), F.lit("_"), F.col(part_no).cast("string"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt to as many tasks as a shuffle has, where few tasks read what makes many rows; AQE leaves a stated number as it is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt_by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt to tasks of about TASK_ROWS rows, so that what a task holds doesn't grow with the table; AQE would join small ones again."""
    spark = df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)


def with_calendar(days: DataFrame) -> DataFrame:
    """Dates with their week, event and whether benefits are paid out."""
    event = F.when((F.month("date") == 12) & (F.dayofmonth("date") == 25), "National").when((F.month("date") == 5) & (F.dayofmonth("date") == 1), "Cultural")
    return days.select("date", week_of(F.col("date")).alias("week"), event.alias("event_type"), (F.dayofmonth("date") <= 10).alias("snap"))


class Raw:
    """The raw tables of one directory. The sales lines and the load log are stored; the rest is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.store = spark, sf_dir, store(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def places(self) -> DataFrame:
        """supplier -> store: a dimension with a row for each supplier."""
        s, n, r = (self.table(t) for t in ("supplier", "nation", "region"))
        joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return joined.select("s_suppkey", F.col("r_name").alias("store"), F.col("r_regionkey").alias("store_no"))

    def parts(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("part_no"), sku_of("p_type", "p_partkey").alias("sku"), F.col("p_name").alias("description"), F.col("p_type").alias("dept"), F.col("p_brand").alias("category"), F.col("p_size").alias("pack"), F.col("p_retailprice").alias("shelf")
        )

    def lines(self) -> DataFrame:
        """True sales lines up to the as-of date. SKU and week follow from other columns and aren't stored; lines aren't sorted
        either: nearly all that reads them reads all of them."""
        return self.store.table("lines", self._lines).select("*", sku_of("dept", "part_no").alias("sku"), week_of(F.col("date")).alias("week"))

    def line_count(self) -> int:
        self.store.table("lines", self._lines)
        return self.store.rows("lines")

    def _lines(self) -> DataFrame:
        x = self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("part_no"), "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("units"), F.col("l_extendedprice").alias("amount"))
        x = x.where(F.col("date") <= day(AS_OF))
        x = x.join(self.places(), x.l_suppkey == F.col("s_suppkey")).drop("l_suppkey", "s_suppkey")
        return x.join(self.parts().select("part_no", "dept", "category", "pack"), "part_no")

    def wide_units(self) -> DataFrame:
        """Units by department with a column for each day of the calendar up to the as-of date."""
        first, last = date.fromisoformat(EPOCH), date.fromisoformat(AS_OF)
        days = [first + timedelta(k) for k in range((last - first).days + 1)]
        each = self.lines().withColumn("k", F.datediff("date", day(EPOCH)) + 1).groupBy("dept", "k").agg(F.sum("units").cast("long").alias("units"))
        each = each.groupBy("dept").agg(F.map_from_entries(F.collect_list(F.struct("k", "units"))).alias("by_day"))
        row = F.transform(F.sequence(F.lit(1), F.lit(len(days))), lambda k: F.coalesce(F.try_element_at("by_day", k), F.lit(0).cast("long")))
        # One column each, as in a wide file: the list is bounded by the calendar.
        wide = self.store.table("wide", lambda: each.select("dept", row.alias("d")))
        return wide.select("dept", *(F.get("d", F.lit(k)).alias(f"d_{k + 1}") for k in range(len(days))))

    def sales_lines(self, faults: bool = True) -> DataFrame:
        """txn_date, store_code, sku_code, qty, uom, load_batch_id."""
        x = self.lines()
        if faults:
            x = inject_outage(inject_uom_alias(x))
        else:
            x = x.select("*", F.col("sku").alias("sku_code"), F.col("units").alias("qty"), F.lit("EA").alias("uom"))
        x = x.withColumn("load_batch_id", F.col("week").cast("long") * 10 + F.col("store_no"))
        out = x.select(F.col("date").alias("txn_date"), F.col("store").alias("store_code"), "sku_code", "qty", "uom", "load_batch_id", "week")
        if faults:
            again = out.where((F.col("store_code") == TWICE_STORE) & (F.col("week") == TWICE_WEEK))
            out = out.unionByName(again.withColumn("load_batch_id", F.col("load_batch_id") + TWICE_STEP))
        return out

    def load_log(self) -> DataFrame:
        return self.store.table("load_log", self._load_log)

    def _load_log(self) -> DataFrame:
        second = F.col("load_batch_id") >= TWICE_STEP
        loaded = F.date_add(day(EPOCH), (F.col("week") + 1) * 7).cast("timestamp_ntz") + F.when(second, F.expr("INTERVAL 79 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
        source = F.concat(F.col("store_code"), F.lit("_w"), F.col("week").cast("string"))
        counted = self.sales_lines().groupBy("load_batch_id", "store_code", "week").agg(F.count("*").alias("row_count"))
        return counted.select("load_batch_id", source.alias("source_file"), loaded.alias("loaded_at"), "row_count")

    def sku_master(self) -> DataFrame:
        p = self.parts()
        n = self.table("supplier").agg(F.count("*").alias("n"))
        lost = F.col("part_no") % 97 == 0
        p = p.crossJoin(F.broadcast(n)).select(  # one row
            F.col("sku").alias("sku_code"),
            "description",
            "dept",
            "category",
            F.lit("EA").alias("base_uom"),
            F.when(lost & (F.col("part_no") % 2 == 0), None).when(lost, 0).otherwise(F.col("pack")).cast("int").alias("case_pack"),
            rounded(F.col("shelf") * 0.6).alias("unit_cost"),
            (F.col("part_no") % F.col("n")).alias("supplier_id"),
            "part_no",
        )
        again = p.where(F.col("part_no") % 40 == 0).withColumn("sku_code", F.replace("sku_code", F.lit("_"), F.lit("-")))
        return p.unionByName(again)

    def suppliers(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"), (3 + F.col("s_suppkey") % 12).cast("int").alias("lead_time_days"), (1 + F.col("s_suppkey") % 10).cast("int").alias("min_order_cases"))

    def true_prices(self) -> DataFrame:
        """Weekly shelf prices by store and department: a row for every week with a line, stored, as medians over all lines are dear."""
        base = lambda: self.lines().groupBy("store", "dept", "week").agg(F.median(F.col("amount") / F.col("units")).alias("price"))
        return self.store.table("true_prices", lambda: base().withColumn("price", rounded(F.col("price"))))

    def price_book(self) -> DataFrame:
        """The prices with mis-keyed and missing weeks."""
        base = self.true_prices()
        first = base.groupBy("store", "dept").agg(F.min("week").alias("first_week"))
        base = base.join(first, ["store", "dept"])
        mark = F.length("dept") + F.col("week")
        kept = base.where((F.col("week") == F.col("first_week")) | (mark % 61 != 7))
        keyed = F.when(mark % 97 == 0, F.col("price") * 100).otherwise(F.col("price"))
        return kept.select("store", "dept", "week", keyed.alias("price"))

    def inventory(self) -> DataFrame:
        stores = self.table("region").select(F.col("r_name").alias("store"), F.col("r_regionkey").alias("store_no"))
        x = dealt(self.parts().select("part_no", "sku", "pack"), "part_no").crossJoin(F.broadcast(stores))  # a snapshot: every store keeps every part
        hand = F.when(F.col("part_no") % 25 == 0, 0).otherwise((F.col("part_no") * 7 + F.col("store_no") * 13) % 60)
        x = x.select("store", "sku", "part_no", hand.cast("long").alias("on_hand"), ((F.col("part_no") % 4) * F.col("pack")).cast("long").alias("on_order"))
        split = F.col("part_no") % 40 == 0
        own = x.select("store", F.col("sku").alias("sku_code"), F.when(split, F.floor(F.col("on_hand") / 2)).otherwise(F.col("on_hand")).alias("on_hand"), "on_order")
        old = x.where(split).select("store", F.replace("sku", F.lit("_"), F.lit("-")).alias("sku_code"), (F.col("on_hand") - F.floor(F.col("on_hand") / 2)).alias("on_hand"), F.lit(0).cast("long").alias("on_order"))
        return own.unionByName(old)

    def true_inventory(self) -> DataFrame:
        split = self.inventory().withColumn("sku", F.replace("sku_code", F.lit("-"), F.lit("_")))
        return split.groupBy("store", "sku").agg(F.sum("on_hand").alias("on_hand"), F.sum("on_order").alias("on_order"))

    def calendar(self) -> DataFrame:
        days = self.spark.sql(f"SELECT explode(sequence(DATE '{EPOCH}', date_add(DATE '{AS_OF}', 28))) AS date")
        return with_calendar(days)


def inject_uom_alias(lines: DataFrame) -> DataFrame:
    """An UPDATE ... FROM as a projection: old codes from a date on, and one store counting in cases."""
    no, sku = F.col("part_no"), F.col("sku")
    late = F.col("date") >= day(ALIAS_FROM)
    code = F.when(late & (no % 40 == 0), F.replace(sku, F.lit("_"), F.lit("-"))).when(late & (no % 40 == 1), F.lower(sku)).when(late & (no % 40 == 2), F.concat(sku, F.lit(" "))).otherwise(sku)
    cases = (F.col("store") == CASE_STORE) & (no % 50 == 3) & (no % 97 != 0) & F.col("date").between(day(CASE_FROM), day(CASE_TO))
    turn = F.col("l_orderkey") % 3
    label = F.when(turn == 0, "CS").when(turn == 1, "cs").otherwise("Case")
    qty = F.when(cases, F.floor(F.col("units") / F.col("pack") * 1000 + 0.5) / 1000).otherwise(F.col("units"))
    return lines.select("*", code.alias("sku_code"), qty.alias("qty"), F.when(cases, label).otherwise("EA").alias("uom"))


def inject_outage(lines: DataFrame) -> DataFrame:
    """A DELETE as a filter: one store's outage and a day on which all stores are closed."""
    out = (F.col("store") == OUTAGE_STORE) & F.col("date").isin(*(day(d) for d in OUTAGE_DAYS))
    return lines.where(~reduce(lambda a, b: a | b, [out, F.col("date") == day(CLOSURE)]))
