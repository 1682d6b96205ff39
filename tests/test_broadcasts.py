from pyspark.sql import functions as F

from supplylens.operators import forecast, questions, reorder
from supplylens.operators.clean import Core
from supplylens.sources.standin import Raw


def joins(df):
    """The joins of a plan, before and without what runs."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]


def test_rows_by_series_and_day_are_merged_whatever_their_files_measure(spark):
    core = Core(Raw(spark, "/root/testdata/sf0.001"))
    assert any("strategy=merge" in x for x in joins(reorder.lines(core)))
    assert not joins(forecast.weekday_baseline(core, "sku"))  # one aggregation by series
    days = forecast.grid(core, forecast.daily(core, "sku"), forecast.shifted(forecast.ORIGIN, -10), forecast.ORIGIN, "sku")
    assert any("strategy=merge" in x for x in joins(days))


def test_answers_are_stored_by_facts_and_merged(spark):
    core = Core(Raw(spark, "/root/testdata/sf0.001"))
    found = questions.ablation(core)
    assert {"answers_clean", "answers_plain"} <= core.raw.store.paths.keys()
    assert sum("strategy=merge" in x for x in joins(found)) >= 3
    assert found.where(F.col("clean") > F.col("n")).count() == 0
