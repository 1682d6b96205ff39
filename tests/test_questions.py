import pytest
from pyspark.sql import functions as F

from supplylens.operators import questions as q
from supplylens.operators.clean import Core
from supplylens.queries import questions as own
from supplylens.sources.standin import OUTAGE_STORE, Raw

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def core(spark):
    return Core(Raw(spark, SF))


def test_every_kind_is_asked_in_both_engines(core):
    assert set(q.KINDS) == set(own.CHOSEN) and {k.form for k in q.KINDS.values() if k.form} <= set(q.FORMS)
    x = q.questions(core)
    assert not x.where("question IS NULL OR question LIKE '%{%' OR key IS NULL").count()
    assert x.groupBy("kind", "key").count().where("count > 1").count() == 0
    traps = {r["kind"] for r in x.where("tier = 'T4'").select("kind").distinct().collect()}
    assert {"missing_day", "out_of_coverage", "nonexistent_field", "action_boundary", "christmas_why", "imputed_case_pack", "horizon"} <= traps


def test_true_facts_answer_their_own_questions(core):
    x = q.scored(core, q.true_facts(core.raw), "ok")
    wrong = {r["kind"] for r in x.where("NOT ok").select("kind").distinct().collect()}
    # Sums over days that the exports lack expect the known days only.
    assert wrong <= {"missing_day_total", "total_over_missing"} and x.count() > 1000


def test_answers_by_hand(core):
    sales = {(r["store"], r["sku"], str(r["date"])): r["units"] for r in core.raw.lines().groupBy("store", "sku", "date").agg(F.sum("units").alias("units")).collect()}
    for r in q.questions(core).where("kind IN ('units_on_day', 'units_alias_sku', 'units_on_day_zero')").collect():
        assert r["number"] == sales.get(tuple(r["key"].split("|")), 0)
    top = {r["key"]: r["label"].split(", ") for r in q.questions(core).where("kind = 'top5_skus'").collect()}
    kinds = {r["sku"]: r["dept"] for r in core.raw.parts().collect()}
    for key, skus in top.items():
        store, dept, month = key.split("|")
        sums = {}
        for (s, sku, d), n in sales.items():
            if s == store and d.startswith(month) and kinds[sku] == dept:
                sums[sku] = sums.get(sku, 0) + n
        best = sorted(sums, key=lambda k: (-sums[k], k))
        assert skus == sorted(best[:5]) and (len(best) < 6 or sums[best[5]] < sums[best[4]])
    assert not q.questions(core).where(F.col("key").startswith(f"{OUTAGE_STORE}|") & F.col("key").endswith("|2000-05") & (F.col("tier") == "T2")).count()


def test_cleaning_pays(core):
    rows = {r["kind"]: r for r in q.ablation(core).collect()}
    for kind in ("units_alias_sku", "on_hand_alias"):
        assert rows[kind]["clean"] == rows[kind]["n"] > rows[kind]["plain"] and rows[kind]["only_clean"] == rows[kind]["n"] - rows[kind]["plain"]
