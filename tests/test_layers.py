import pytest
from pyspark.sql import functions as F

from supplylens.operators import anomalies, forecast
from supplylens.operators.clean import Core
from supplylens.plans.run_sql import run_sql
from supplylens.sources import standin
from supplylens.sources.standin import Raw
from supplylens.sources.store import Store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def core(spark):
    raw = Raw(spark, SF)
    raw.store = Store(spark)
    return Core(raw)


def test_facts_are_dealt_by_rows(core, monkeypatch):
    """A task's share doesn't grow with the table, whatever number of partitions a shuffle has."""
    monkeypatch.setattr(standin, "TASK_ROWS", 500)
    n = core.raw.line_count()
    assert n == core.raw.lines().count()
    assert core._facts().rdd.getNumPartitions() == -(-n // 500) > int(core.raw.spark.conf.get("spark.sql.shuffle.partitions"))


def test_facts_know_their_department(core):
    """Days of a department are summed without a look-up by SKU; the table itself has its five columns, in SQL too."""
    looked_up = core.fact_sales_daily.join(core.dim_sku.select("sku", "dept", "category"), "sku")
    columns = ["date", "store", "sku", "units", "n_lines", "dept", "category"]
    assert core.facts().select(columns).exceptAll(looked_up.select(columns)).count() == 0
    assert core.facts().count() == looked_up.count() > 1000
    days = looked_up.groupBy("date", "store", "dept").agg(F.sum("units").cast("long").alias("units"))
    assert forecast.daily(core).select(days.columns).exceptAll(days).count() == 0
    assert core.fact_sales_daily.columns == columns[:5]
    assert list(run_sql(core, "SELECT * FROM core.fact_sales_daily LIMIT 1", seconds=60).data[0]) == columns[:5]


def test_medians_are_made_once_and_prices_need_no_shuffle_of_facts(core):
    prices = core.fact_price_weekly
    assert "true_prices" in core.raw.store.paths
    keys = ["store", "dept", "week"]
    sold = core.raw.lines().select(keys).distinct()
    assert core.raw.true_prices().select(keys).exceptAll(sold).count() == 0 == sold.exceptAll(core.raw.true_prices().select(keys)).count()
    built, seen = {}, Core(Raw(core.raw.spark, SF))
    seen.raw.store = Store(core.raw.spark)
    seen.raw.store.paths, seen.raw.store.schemas = dict(core.raw.store.paths), dict(core.raw.store.schemas)
    seen.raw.store.paths.pop("sales_enriched", None)
    table = seen.raw.store.table
    seen.raw.store.table = lambda name, build, by=None: table(name, lambda: built.setdefault(name, build()), by)
    assert seen.sales_enriched.count() == core.fact_sales_daily.count()
    plan = built["sales_enriched"]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sku" not in plan and "Sort [date" not in plan
    assert prices.count() >= core.raw.true_prices().count()


def test_suppliers_meet_skus_before_the_stock(core):
    plan = anomalies.inventory_anomalies(core)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    deep = {k: [len(x) - len(x.lstrip(" :+-")) for x in plan if "Join Inner" in x and f"({k}#" in x] for k in ("supplier_id", "sku")}
    assert min(deep["supplier_id"]) > min(deep["sku"])
