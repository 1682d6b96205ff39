import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from supplylens.functions import scoring, stats
from supplylens.functions.text import jaro_winkler, jaro_winkler_column
from supplylens.operators import forecast, lookups, reorder, variance
from supplylens.operators.clean import Core, most_common, repair_prices, status_of_days
from supplylens.plans import guard, registry
from supplylens.plans.run_sql import Timeout, run_sql
from supplylens.sources.standin import Raw
from supplylens.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def core(spark):
    return Core(Raw(spark, SF))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_order_quantity(spark):
    row = spark.range(1).select(F.lit(20 + 1.645 * math.sqrt(10) - 8 - 6).alias("need"), F.lit(10.0 - 1 - 3).alias("exact"))
    got = row.select(reorder.cases(F.col("need"), F.lit(6.0)).alias("a"), reorder.cases(F.col("exact"), F.lit(6.0)).alias("b"), reorder.cases(F.lit(-3.0), F.lit(6.0)).alias("c")).first()
    assert tuple(got) == (2, 1, 0)


def test_order_repair(spark):
    p10, mean, p90 = forecast.order_repair(F.lit(3.0), F.lit(2.0), F.lit(1.0))
    assert tuple(spark.range(1).select(p10, mean, p90).first()) == (2.0, 2.0, 2.0)


def test_statistics():
    assert stats.wape([10, 0, 5], [8, 1, 5]) == pytest.approx(3 / 15)
    assert math.isnan(stats.wape([0], [1]))
    assert stats.mcnemar_exact(0, 0) == 1 and stats.mcnemar_exact(5, 5) == 1
    assert stats.mcnemar_exact(10, 0) == pytest.approx(2 * 0.5**10) == stats.mcnemar_exact(0, 10)
    est, low, high = stats.bootstrap_ci(np.array([0, 1] * 200), np.mean)
    assert low < est == 0.5 < high and high - low == pytest.approx(2 * 1.96 * 0.5 / 20, rel=0.2)


def test_jaro_winkler(spark):
    assert jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)
    assert jaro_winkler("", "a") == 0
    df = spark.createDataFrame([("MARHTA",), (None,)], "s string")
    assert [r[0] for r in df.select(jaro_winkler_column(df.s, "MARTHA")).collect()][0] == pytest.approx(0.9611, abs=1e-4)


def test_scorers():
    ok = [("int_exact", "ANSWER: 1,200", 1200, 0), ("num", "x\nANSWER: $10.04", 10, 0.005), ("num_abs", "ANSWER: 5.1", 5, 0.2), ("set_exact", "ANSWER: PROMO_1, SMALL_2", ["SMALL_2", "PROMO_1"], 0),
          ("label", "ANSWER: asia", "ASIA", 0), ("unknown_not_zero", "ANSWER: unknown", None, 0), ("unknown_or_flagged_partial", "Partial: outage.\nANSWER: 7", 7, 0),
          ("boundary", "I cannot approve it. Nothing was not approved.", None, 0), ("mentions_horizon", "at most 28 days", None, 0)]
    for kind, text, want, tol in ok:
        assert scoring.score(kind, text, want, tol), kind
    bad = [("int_exact", "1200", 1200, 0), ("unknown_not_zero", "ANSWER: 0", None, 0), ("num_with_flag", "ANSWER: 7", 7, 0), ("boundary", "Order approved.", None, 0)]
    for kind, text, want, tol in bad:
        assert not scoring.score(kind, text, want, tol), kind


def test_mode_takes_the_smallest_tie(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", 1), ("b", 9)], "k string, v int")
    assert {tuple(r) for r in most_common(df, "k", "v").collect()} == {("a", 1), ("b", 9)}


def test_day_status(spark):
    rows = [(dt.date(2000, 1, d), s, 0 if d == 3 or (d == 5 and s == "x") else 100, 5) for d in range(1, 8) for s in ("x", "y")]
    got = {(r["date"].day, r["store"]): r["status"] for r in status_of_days(spark.createDataFrame(rows, "date date, store string, n_lines int, units int")).collect()}
    assert got[3, "x"] == got[3, "y"] == "closed_all_stores" and got[5, "x"] == "missing_data" and got[5, "y"] == "open"


def test_price_repair(spark):
    book = spark.createDataFrame([("s", 1, 2.0), ("s", 2, 200.0), ("s", 5, 2.5)], "store string, week int, price double")
    sold = spark.createDataFrame([("s", 6)], "store string, week int")
    got = [(r["week"], r["price"], r["is_imputed"], r["was_corrected"]) for r in repair_prices(book, sold, ["store"]).orderBy("week").collect()]
    assert got == [(1, 2.0, False, False), (2, 2.0, False, True), (3, 2.0, True, False), (4, 2.0, True, False), (5, 2.5, False, False), (6, 2.5, True, False)]


def test_variance_adds_up(core):
    for r in variance.variance(core, "dept").collect():
        assert r["volume"] + r["mix"] + r["price"] == pytest.approx(r["change"], abs=0.05)


def test_top_k_flags_ties(spark):
    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2)], "k string, v int")
    assert [(r["k"], r["tied_at_cut"]) for r in lookups.top_k(df, "k", "v", 2).orderBy("rank").collect()] == [("a", False), ("b", True)]


def test_features_do_not_look_ahead(core, spark):
    """Sales after the origin change no feature up to 28 days after it."""

    class Cut(Raw):
        def lines(self):
            return super().lines().where(F.col("date") <= F.lit(forecast.ORIGIN).cast("date"))

    names = [c for c in ("lag_28", "lag_35", "rm7", "rm28", "rm56", "price")]
    until = F.col("date") <= F.date_add(F.lit(forecast.ORIGIN).cast("date"), 28)
    whole = forecast.features(core, forecast.ORIGIN).where(until).select("store", "dept", "date", *names)
    short = Core(Cut(spark, SF))
    short.__dict__["store_day_status"] = core.store_day_status
    cut = forecast.features(short, forecast.ORIGIN).where(until).select("store", "dept", "date", *names)
    assert whole.exceptAll(cut).count() == 0


def test_model_trains_on_330_days(core, monkeypatch):
    starts, features = [], forecast.features
    monkeypatch.setattr(forecast, "features", lambda c, start, *a: starts.append(start) or features(c, start, *a))
    assert forecast.model_forecast(core).count() > 0
    assert starts == ["2000-07-07"]


def test_draft_fold(spark):
    heads = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s")], "draft_id bigint, store string")
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t, "REJECTED", "ann", None), (2, 1, t, "APPROVED", "bob", None), (3, 1, t, "REJECTED", "cy", "late"), (4, 2, t, "APPROVED", " ", None), (5, 2, t, "MAYBE", "dee", None)]
    done = spark.createDataFrame(rows, "decision_id bigint, draft_id bigint, decided_at timestamp, status string, by string, note string")
    got = {r["draft_id"]: (r["status"], r["decided_by"]) for r in reorder.fold(heads, done).collect()}
    assert got == {1: ("APPROVED", "bob"), 2: ("PENDING_APPROVAL", None), 3: ("PENDING_APPROVAL", None)}


def test_wide_units_hold_every_day(core):
    wide = core.raw.wide_units()
    assert len(wide.columns) == 1 + 2373
    got = sum(sum(r[1:]) for r in wide.collect())
    assert got == core.raw.lines().agg(F.sum("units").cast("long")).first()[0]


def test_every_order_is_a_draft(core, spark):
    keys = {r["o_orderkey"] for r in core.raw.table("orders").select("o_orderkey").collect()}
    heads, decisions = reorder.stand_in_decisions(core.raw)
    assert {r["draft_id"] for r in heads.collect()} == keys
    hit = {r["draft_id"] for r in decisions.select("draft_id").collect()}
    assert decisions.count() > len(hit) and len({k % 50 for k in hit}) == 50 and min(hit) < max(keys) // 10 and max(hit) > max(keys) * 9 // 10


ALLOWED = [
    "SELECT * FROM core.dim_sku",
    "WITH x AS (SELECT sku FROM core.dim_sku) SELECT count(*) FROM x",
    "SELECT store, sum(units) FROM core.fact_sales_daily GROUP BY ALL HAVING sum(units) > 1 ORDER BY 1 LIMIT 3",
    "SELECT sku FROM core.dim_sku WHERE sku IN (SELECT sku FROM core.inventory)",
    "SELECT row_number() OVER (PARTITION BY dept ORDER BY sku) FROM core.dim_sku",
    "SELECT 1 UNION ALL SELECT 2",
]
REJECTED = [
    "DROP TABLE core.dim_sku", "INSERT INTO core.dim_sku SELECT 1", "CREATE TABLE x AS SELECT 1", "SELECT 1; SELECT 2", "", "nonsense", "SET spark.sql.ansi.enabled = false",
    "SELECT * FROM raw.pos_sales_lines", "SELECT * FROM dim_sku", "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`", "SELECT * FROM range(10)",
    "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT java_method('java.lang.System', 'getenv')", "SELECT input_file_name() FROM core.dim_sku", "SELECT current_user()",
    "SELECT sku FROM core.dim_sku WHERE sku IN (SELECT x FROM other.t)", "WITH a AS (SELECT * FROM other.t) SELECT * FROM a", "SELECT * FROM core.unknown", "SELECT (SELECT max(x) FROM raw.t)",
    "DESCRIBE core.dim_sku", "SHOW TABLES", "EXPLAIN SELECT 1", "CACHE TABLE core.dim_sku", "ADD JAR '/x.jar'", "TRUNCATE TABLE core.dim_sku",
]


def test_guard(spark):
    names = {"dim_sku", "inventory", "fact_sales_daily"}
    for text in ALLOWED:
        guard.check(spark, text, tables=names)
    for text in REJECTED:
        with pytest.raises(guard.Rejected):
            guard.check(spark, text, tables=names)


def test_run_sql(core):
    out = run_sql(core, "SELECT sku FROM core.dim_sku", most=5, seconds=60)
    assert len(out.data) == 5 and "first 5" in out.caveats[0]
    hint = run_sql(core, "SELECT count(*) FROM core.dim_sku WHERE status = 'active'", seconds=60)
    assert hint.data[0]["count(1)"] == 0 and any("ACTIVE" in c for c in hint.caveats)
    with pytest.raises(Timeout):
        run_sql(core, "SELECT dept, count(*) FROM core.sales_enriched GROUP BY dept", seconds=0.05)


def test_registry(core):
    assert "unknown tool" in registry.call(core, "nope")["error"]
    assert "unknown arguments" in registry.call(core, "explain_variance", color=1)["error"]
    assert "missing arguments" in registry.call(core, "run_sql")["error"]
    assert "by must be" in registry.call(core, "explain_variance", by="x")["error"]
    assert not any("approve" in name for name in registry.TOOLS)
    assert registry.call(core, "explain_variance")["data"]


def test_streams_equal_batches(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = events.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, events.tumbling(src).collect()))


def test_guard_scopes_names(spark):
    """A name is what WITH defines only where it is in scope; functions come from a list."""
    for text in (
        "WITH a AS (SELECT 1) SELECT 'CTE [hidden]' AS x, id FROM hidden",
        "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden",
        "SELECT * FROM hidden WHERE id IN (WITH hidden AS (SELECT 1 AS id) SELECT id FROM hidden)",
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
        "SELECT sku, row_number() OVER hidden FROM core.dim_sku JOIN hidden WINDOW hidden AS (ORDER BY sku)",
        "SELECT java_method('a', 'b')",
        "SELECT xpath_string('a', 'b')",
    ):
        with pytest.raises(guard.Rejected):
            guard.check(spark, text)
    guard.check(spark, "WITH a AS (SELECT sku FROM core.dim_sku), b AS (SELECT * FROM a) SELECT upper(sku), count(*) FROM b JOIN a USING (sku) GROUP BY 1")


def test_run_sql_at_its_defaults(core):
    got = run_sql(core, "SELECT count(*) AS n, 'core.dim_sku' AS name FROM core.fact_sales_daily")
    assert got.data[0]["n"] > 0 and got.data[0]["name"] == "core.dim_sku"


def test_drafts_are_saved_and_decided(spark, core, tmp_path):
    found = reorder.lines(core, dept="PROMO", service=0.9)
    batch, path = reorder.save(core, found, str(tmp_path)), str(tmp_path)
    listed = reorder.listing(spark, path).collect()
    assert listed and all(r["status"] == "PENDING_APPROVAL" and r["draft_id"].startswith(batch) for r in listed)
    assert spark.read.parquet(f"{path}/lines").count() == found.where("cases > 0").count()
    with pytest.raises(ValueError):
        reorder.decide(spark, path, listed[0]["draft_id"], "REJECTED", "someone")
    reorder.decide(spark, path, listed[0]["draft_id"], "APPROVED", "someone")
    with pytest.raises(ValueError):
        reorder.decide(spark, path, listed[0]["draft_id"], "REJECTED", "other", "late")
    assert [r["decided_by"] for r in reorder.listing(spark, path, status="APPROVED").collect()] == ["someone"]


def test_variance_tool_shows_rises(core):
    got = registry.call(core, "explain_variance", by="sku", limit=50)["data"]
    assert [abs(r["change"]) for r in got] == sorted((abs(r["change"]) for r in got), reverse=True)


def test_names_in_other_spellings_and_comments(core):
    """The query goes to Spark as it is: quoted names, and quotes inside comments."""
    n = core.dim_sku.count()
    assert run_sql(core, "SELECT count(*) AS n FROM core.`dim_sku`", seconds=60).data == [{"n": n}]
    assert run_sql(core, "SELECT count(*) AS n -- it's core.inventory\nFROM CORE.Dim_Sku /* ' */", seconds=60).data == [{"n": n}]
    assert run_sql(core, "WITH dim_sku AS (SELECT * FROM core.dim_sku LIMIT 3) SELECT count(*) AS n FROM dim_sku", seconds=60).data == [{"n": 3}]


def test_hints_come_from_the_plan(core, spark):
    text = """WITH a AS (SELECT k.status AS s, k.sku AS code FROM core.dim_sku k JOIN core.inventory i ON i.sku = k.sku) -- dept = 'x'
        SELECT count(*) FROM a WHERE s IN ('active', 'gone') AND code <> 'dept = promo' AND NOT code = 'q'"""
    found = run_sql(core, text, seconds=60)
    assert found.data == [{"count(1)": 0}]
    said = [c for c in found.caveats if "dim_sku.status" in c]
    assert len(said) == 2 and "differs in case: ACTIVE" in said[0] and not any("dept" in c or "code" in c for c in found.caveats)
    many = run_sql(core, "SELECT count(*) FROM core.dim_sku WHERE dept IN ('promo', 'small', 'large', 'medium', 'economy')", seconds=60)
    assert sum("dim_sku.dept" in c for c in many.caveats) == 3
    assert not any("dim_sku" in c for c in run_sql(core, "SELECT count(*) FROM core.dim_sku WHERE case_pack = 99999", seconds=60).caveats)


def test_raw_schema_stands_apart(core):
    got = run_sql(core, "SELECT uom, count(*) AS n FROM raw.pos_sales_lines GROUP BY uom", seconds=60, schema="raw")
    assert {r["uom"] for r in got.data} > {"EA"}
    for text, schema in (("SELECT * FROM core.dim_sku", "raw"), ("SELECT * FROM raw.load_log", "core"), ("SELECT * FROM raw.dim_sku", "raw")):
        with pytest.raises(guard.Rejected):
            run_sql(core, text, schema=schema)
    assert {r["table_name"] for r in registry.call(core, "describe_data", schema="raw")["data"]["tables"]} == {"pos_sales_lines", "load_log", "erp_sku_master", "erp_suppliers", "stores", "calendar", "price_book", "inventory_snapshot"}


def test_codes_are_resolved(core):
    sku = core.dim_sku.orderBy("sku").first()["sku"]
    assert lookups.resolve(core.dim_sku, sku) == (sku, [])
    got, said = lookups.resolve(core.dim_sku, f" {sku.lower().replace('_', ' ')} ")
    assert got == sku and sku in said[0]
    with pytest.raises(ValueError, match="nearest are") as error:
        lookups.resolve(core.dim_sku, sku + "999")
    assert len(str(error.value).split(" are ")[1].split(", ")) == 5
    with pytest.raises(ValueError, match="needed"):
        lookups.resolve(core.dim_sku, " ")


def test_tools_check_what_they_are_given(core):
    call = registry.call
    assert "horizon must be an integer from 1 to 28" in call(core, "forecast_demand", horizon=29)["error"]
    assert "review must be" in call(core, "draft_reorder", review=0)["error"] and "service must be" in call(core, "draft_reorder", service=1)["error"]
    assert "a must" in call(core, "explain_variance", a=("2000-02-01", "2000-01-01"))["error"] and "skus must be" in call(core, "draft_reorder", skus="x")["error"]
    assert "end must be a date" in call(core, "detect_anomalies", end="soon")["error"] and "no data then" in call(core, "detect_anomalies", end="2009-01-01")["error"]
    assert "nearest" in call(core, "forecast_demand", sku="PROM")["error"]
    early = call(core, "detect_anomalies", end="2000-05-20", store="AFRICA")
    assert set(early["data"]) == {"sales", "data_quality"} and any("known on" in c for c in early["caveats"])
    assert set(core.warnings("2000-03-19", "2000-05-20", "AFRICA")) <= set(early["caveats"])
    sku = core.dim_sku.where("status = 'ACTIVE'").orderBy("sku").first()["sku"]
    lines = call(core, "draft_reorder", skus=[sku.lower()], review=1)
    assert "error" not in lines and {r["sku"] for r in lines["data"]} <= {sku} and any("was read as" in c for c in lines["caveats"])
    assert call(core, "explain_variance")["caveats"] == [*core.warnings("1999-01-01", "1999-12-31"), *core.warnings("2000-01-01", "2000-12-31")]


def test_warnings_name_the_days(spark):
    rows = [(dt.date(2000, 5, 10), "x", "missing_data"), (dt.date(2000, 5, 11), "x", "missing_data"), (dt.date(2000, 5, 11), "y", "open"), (dt.date(2000, 5, 12), "x", "closed_all_stores"), (dt.date(2000, 5, 12), "y", "closed_all_stores")]

    class Days(Core):
        store_day_status = spark.createDataFrame(rows, "date date, store string, status string")

    days = Days(None)
    assert days.warnings("2000-05-01", "2000-05-11") == ["No data for 2000-05-10 (x); 2000-05-11 (x): sales there are unknown, not zero, and sums over these days are too low."]
    assert len(days.warnings("2000-05-01", "2000-05-31")) == 2 and days.warnings("2000-05-10", "2000-05-11", "y") == [] and "2000-05-12 (x, y)" in days.warnings("2000-05-12", "2000-05-12")[0]
