from pyspark.sql import functions as F

from supplylens.operators import relational
from supplylens.operators.bootstrap import draws
from supplylens.operators.clean import Core
from supplylens.sources.standin import Raw

SF = "/root/testdata/sf0.001"


def test_stored_lines_hold_no_column_that_follows_from_others(spark):
    raw = Raw(spark, SF)
    assert {"sku", "week", "description", "units"} - set(raw.lines().columns) == {"description"}
    stored = set(raw.store.schemas["lines"].names)
    assert not stored & {"sku", "week", "description", "shelf", "l_partkey", "l_suppkey", "s_suppkey"}


def test_recovery_equals_except_all_both_ways(spark):
    core, raw = Core(Raw(spark, SF)), Raw(spark, SF)
    true = raw.lines().groupBy("date", "store", "sku").agg(F.sum("units").cast("long").alias("units"))
    fact = core.fact_sales_daily.select("date", "store", "sku", "units")
    want = true.exceptAll(fact).count() + fact.exceptAll(true).count()
    assert relational.recovery(core, raw).agg(F.sum("rows")).first()[0] == want > 0


def test_few_partitions_are_dealt_before_rows_multiply(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert Raw(spark, SF).inventory().rdd.getNumPartitions() >= n
    units = spark.range(500).coalesce(1).select("id", F.lit(1.0).alias("v"))
    plan = draws(units, "id", ["v"], n=10)._jdf.queryExecution().optimizedPlan().toString()
    assert f"], {n}" in plan or "RepartitionByExpression" in plan
    assert draws(units, "id", ["v"], n=10).count() == 10
