import pytest
from pyspark.sql import functions as F

from supplylens.operators import questions as q
from supplylens.operators.clean import Core
from supplylens.sources.standin import Raw


@pytest.fixture(scope="module")
def core(spark):
    return Core(Raw(spark, "/root/testdata/sf0.001"))


def test_answers_are_those_asked_for_and_no_other_days(core):
    """Of days and weeks only what questions ask for is answered and shuffled, and nothing of that is lost."""
    asked = q.asked_for(core).cache()
    wanted = asked.select("form", F.col("short").alias("key")).distinct()
    for facts in (q.clean_facts(core), q.raw_facts(core)):
        some, every = q.answers(facts, asked).cache(), q.answers(facts).cache()
        assert some.exceptAll(every).count() == 0
        assert every.join(wanted, ["form", "key"], "left_semi").exceptAll(some).count() == 0
        n = lambda x, form: x.where(F.col("form") == form).count()
        assert 0 < n(some, "day") <= n(wanted, "day") < n(every, "day")
        assert 0 < n(some, "week") < n(every, "week") / 20


def test_days_without_a_sale_are_found_without_a_row_for_each(core):
    """The first open day of each item on which it wasn't sold, without a cross join of items and days."""
    t = q.true_facts(core.raw)
    x = q.chosen(core, t)["units_on_day_zero"]
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and x.count() > 10
    sold = {(r["store"], r["sku"], str(r["date"])) for r in t.sales.select("store", "sku", "date").distinct().collect()}
    days = [str(r["date"]) for r in core.raw.calendar().where(F.col("date").between(*q.ZERO_DAYS)).orderBy("date").collect()]
    for r in x.collect():
        store, sku, day = r["key"].split("|")
        assert day == next(d for d in days if (store, sku, d) not in sold)
