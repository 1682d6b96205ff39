"""A question set whose answers come from the true facts, and how often other facts give the same.

Facts are daily sales, weekly prices, stock, items and suppliers: the true ones, the cleaned ones, or the exports as
they came. An answer table holds the answers of one form for all its keys, so hundreds of questions of a
kind take one scan of the facts and a join. Questions are chosen where the true facts allow one answer only:
no ties at a cut, no windows that hinge on days without data. Traps ask for what can't be known or must not
be done.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded
from supplylens.operators import forecast, reorder
from supplylens.operators.clean import STALE_DAYS, Core
from supplylens.operators.variance import A, B, explain
from supplylens.sources.standin import ALIAS_FROM, AS_OF, CASE_FROM, CASE_STORE, CASE_TO, CLOSURE, EPOCH, OUTAGE_DAYS, OUTAGE_STORE, TWICE_STORE, TWICE_WEEK, Raw, day, sku_of, week_of

YEAR = ("2000-01-01", "2000-12-31")
ZERO_DAYS = ("2000-04-04", "2000-04-27")
SOLD_IN = ("2000-04-01", "2000-04-30")


@dataclass
class Facts:
    """sales: date, store, sku, dept, category, units; prices: store, dept, week, price; stock: store, sku, on_hand,
    on_order; items: sku, dept, category, status, supplier_id; suppliers: supplier_id, lead_time_days."""

    sales: DataFrame
    prices: DataFrame
    stock: DataFrame
    items: DataFrame
    suppliers: DataFrame


def true_facts(raw: Raw) -> Facts:
    lines, n = raw.lines(), raw.table("supplier").agg(F.count("*").alias("n"))
    # Stored and shuffled by number: the SKU follows from it.
    daily = raw.store.table("true_daily", lambda: lines.groupBy("date", "store", "part_no", "dept", "category").agg(F.sum("units").alias("units")), "date")
    daily = daily.select("date", "store", sku_of("dept", "part_no").alias("sku"), "dept", "category", "units")
    last = daily.groupBy("sku").agg(F.max("date").alias("last_date"))
    status = F.when(F.col("last_date") >= F.date_sub(day(AS_OF), STALE_DAYS), "ACTIVE").otherwise("DISCONTINUED")
    items = raw.parts().crossJoin(F.broadcast(n)).join(last, "sku", "left")  # one row
    items = items.select("sku", "dept", "category", status.alias("status"), (F.col("part_no") % F.col("n")).alias("supplier_id"), "part_no")
    return Facts(daily, raw.true_prices(), raw.true_inventory(), items, raw.suppliers())


def clean_facts(core: Core) -> Facts:
    sales = core.facts().select("date", "store", "sku", "dept", "category", F.col("units").cast("double").alias("units"))
    return Facts(sales, core.fact_price_weekly.select("store", "dept", "week", "price"), core.inventory, core.dim_sku, core.raw.suppliers())


def raw_facts(core: Core) -> Facts:
    """The exports read as if nothing were wrong with them: codes as they are, quantities as units, every load counted."""
    raw = core.raw
    items = raw.sku_master().select(F.col("sku_code").alias("sku"), "dept", "category", F.lit("ACTIVE").alias("status"), "supplier_id")
    sums = lambda: raw.sales_lines().groupBy(F.col("txn_date").alias("date"), F.col("store_code").alias("store"), F.col("sku_code").alias("sku")).agg(F.sum("qty").alias("units"))
    sales = raw.store.table("plain_daily", lambda: sums().join(items.select("sku", "dept", "category"), "sku", "left"), "date")
    return Facts(sales, raw.price_book(), raw.inventory().withColumnRenamed("sku_code", "sku"), items, raw.suppliers())


def key(*columns: str) -> Column:
    return F.concat_ws("|", *(F.col(c).cast("string") for c in columns)).alias("key")


def _revenue(f: Facts) -> DataFrame:
    x = f.sales.withColumn("week", week_of(F.col("date"))).join(f.prices, ["store", "dept", "week"])
    return x.withColumn("revenue", rounded(F.col("units") * F.col("price")))


def _year(x: DataFrame) -> DataFrame:
    return x.where(F.col("date").between(day(YEAR[0]), day(YEAR[1]))).withColumn("month", F.date_format("date", "yyyy-MM"))


def _number(x: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return x.groupBy(*keys).agg(rounded(value.cast("double")).alias("number")).select(key(*keys), "number", F.lit(None).cast("string").alias("label"))


def _top5(f: Facts) -> DataFrame:
    x = _year(f.sales).groupBy("store", "dept", "month", "sku").agg(F.sum("units").alias("units"))
    w = Window.partitionBy("store", "dept", "month").orderBy(F.desc("units"), "sku")
    ranked = x.select("*", F.row_number().over(w).alias("place"), F.lead("units").over(w).alias("next")).where("place <= 5 AND dept IS NOT NULL")
    cut = F.max(F.when(F.col("place") == 5, (F.col("units") != F.coalesce("next", F.lit(0.0))).cast("int")))
    return ranked.groupBy("store", "dept", "month").agg(F.array_join(F.array_sort(F.collect_list("sku")), ", ").alias("label"), cut.alias("clear")).select(key("store", "dept", "month"), F.lit(None).cast("double").alias("number"), "label", "clear")


def _top_store(f: Facts) -> DataFrame:
    x = _year(_revenue(f)).groupBy("category", "month", "store").agg(rounded(F.sum("revenue")).alias("revenue"))
    best = x.groupBy("category", "month").agg(F.max_by("store", F.struct("revenue", "store")).alias("label"))
    return best.select(key("category", "month"), F.lit(None).cast("double").alias("number"), "label")


def _share(f: Facts) -> DataFrame:
    part = _year(_revenue(f)).groupBy("store", "month", "category").agg(F.sum("revenue").alias("v"))
    whole = part.groupBy("store", "month").agg(F.sum("v").alias("all"))
    x = part.join(whole, ["store", "month"]).withColumn("number", rounded(100 * F.col("v") / F.nullif(F.col("all"), F.lit(0.0))))
    return x.select(key("store", "category", "month"), "number", F.lit(None).cast("string").alias("label"))


def _week_change(f: Facts) -> DataFrame:
    x = _year(f.sales).groupBy("store", week_of(F.col("date")).alias("week")).agg(F.sum("units").alias("now"))
    prior = x.select("store", (F.col("week") + 1).alias("week"), F.col("now").alias("prior"))
    change = rounded(100 * (F.col("now") - F.col("prior")) / F.nullif(F.col("prior"), F.lit(0.0)))
    return x.join(prior, ["store", "week"]).select(key("store", "week"), change.alias("number"), F.lit(None).cast("string").alias("label"))


def _stock(f: Facts, hit: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """Active items of a store and department that a rule hits; the rate is that of 365 days."""
    sold = f.sales.where((F.col("date") > F.date_sub(day(AS_OF), 365)) & (F.col("date") <= day(AS_OF))).groupBy("store", "sku").agg(F.sum("units").alias("u"))
    x = f.stock.join(f.items.where("status = 'ACTIVE'").select("sku", "dept", "supplier_id"), "sku").join(f.suppliers.select("supplier_id", "lead_time_days"), "supplier_id").join(sold, ["store", "sku"], "left")
    rate = F.coalesce("u", F.lit(0.0)) / 365.0
    return _number(x, ["store", "dept"], F.count(F.when(hit(F.col("on_hand"), F.col("on_order"), rate, F.col("lead_time_days")), 1)))


def _drivers(f: Facts) -> DataFrame:
    """The department of a store whose revenue rose most from one year to the next, and by which effect, where both are clear."""
    x, inside = _revenue(f), lambda p: F.col("date").between(day(p[0]), day(p[1]))
    x = x.where(inside(A) | inside(B)).groupBy("store", "dept", "sku").agg(*(F.coalesce(F.sum(F.when(inside(p), F.col(c))), F.lit(0.0)).alias(f"{n}_{k}") for k, p in (("a", A), ("b", B)) for n, c in (("q", "units"), ("r", "revenue"))))
    own = lambda k: F.col(f"r_{k}") / F.nullif(F.col(f"q_{k}"), F.lit(0.0))
    g = explain(x.withColumn("p_a", F.coalesce(own("a"), own("b"), F.lit(0.0))), ["store", "dept"])
    effects = F.reverse(F.array_sort(F.array(*(F.struct(F.abs(F.col(c)).alias("size"), F.lit(c).alias("name")) for c in ("volume", "mix", "price")))))
    w = Window.partitionBy("store").orderBy(F.desc("change"), "dept")
    g = g.select("store", "dept", "change", effects.alias("e"), F.row_number().over(w).alias("place"), F.lead("change").over(w).alias("second"))
    clear = (F.col("change") > 0) & (F.col("change") >= 1.2 * F.greatest(F.coalesce("second", F.lit(0.0)), F.lit(0.0))) & (F.col("e")[0]["size"] >= 1.5 * F.col("e")[1]["size"])
    return g.where("place = 1").select(key("store"), F.lit(None).cast("double").alias("number"), F.concat_ws(", ", "dept", F.col("e")[0]["name"]).alias("label"), clear.cast("int").alias("clear"))


#: Answer tables by form: the answers of all keys in one pass.
FORMS: dict[str, Callable[[Facts], DataFrame]] = {
    "day": lambda f: _number(f.sales, ["store", "sku", "date"], F.sum("units")),
    "price": lambda f: _number(f.prices, ["store", "dept", "week"], F.max("price")),
    "stock": lambda f: _number(f.stock, ["store", "sku"], F.sum("on_hand")),
    "lead": lambda f: _number(f.items.join(f.suppliers, "supplier_id"), ["sku"], F.max("lead_time_days")),
    "week": lambda f: _number(f.sales.withColumn("week", week_of(F.col("date"))), ["store", "sku", "week"], F.sum("units")),
    "dept_revenue": lambda f: _number(_year(_revenue(f)), ["store", "dept", "month"], F.sum("revenue")),
    "category_units": lambda f: _number(_year(f.sales).where("category IS NOT NULL"), ["category", "month"], F.sum("units")),
    "distinct": lambda f: _number(_year(f.sales).where("dept IS NOT NULL"), ["store", "dept", "month"], F.countDistinct("sku")),
    "top5": _top5, "top_store": _top_store, "share": _share, "change": _week_change,
    "stockouts": lambda f: _stock(f, lambda hand, order, rate, lead: (hand == 0) & (rate > 0)),
    "risk": lambda f: _stock(f, lambda hand, order, rate, lead: (hand > 0) & (rate > 0) & ((hand + order) / F.nullif(rate, F.lit(0.0)) < lead)),
    "driver": _drivers,
    "dept_week": lambda f: _number(f.sales.where("dept IS NOT NULL").withColumn("week", week_of(F.col("date"))), ["store", "dept", "week"], F.sum("units")),
    "store_month": lambda f: _number(_year(f.sales), ["store", "month"], F.sum("units")),
    "day_total": lambda f: _number(f.sales, ["date"], F.sum("units")),
    "store_day": lambda f: _number(f.sales, ["store", "date"], F.sum("units")),
}


@dataclass(frozen=True)
class Kind:
    """A kind of question: its form, how an answer is scored and how far it may be off; {0}, {1}, ... are parts of the key."""

    tier: str
    form: str | None
    scorer: str
    tolerance: float
    text: str


KINDS = {
    "units_on_day": Kind("T1", "day", "int_exact", 0, "How many units of {1} did {0} sell on {2}?"),
    "units_on_day_zero": Kind("T1", "day", "int_exact", 0, "What were the unit sales of {1} at {0} on {2}?"),
    "units_cases_window": Kind("T1", "day", "int_exact", 0, "How many units of {1} did {0} sell on {2}?"),
    "units_alias_sku": Kind("T1", "day", "int_exact", 0, "How many units of {1} did {0} sell on {2}?"),
    "price_in_week": Kind("T1", "price", "num", 0.005, "What was the price of {1} at {0} in week {2}?"),
    "price_cents_error": Kind("T1", "price", "num", 0.005, "What was the price of {1} at {0} in week {2}?"),
    "on_hand": Kind("T1", "stock", "int_exact", 0, "How many units of {1} does {0} have on hand?"),
    "on_hand_alias": Kind("T1", "stock", "int_exact", 0, "How many units of {1} does {0} have on hand?"),
    "lead_time": Kind("T1", "lead", "int_exact", 0, "How many days does the supplier of {0} need?"),
    "week_units_dup_load": Kind("T1", "week", "int_exact", 0, "How many units of {1} did {0} sell in week {2}?"),
    "week_units": Kind("T1", "week", "int_exact", 0, "How many units of {1} did {0} sell in week {2}?"),
    "dept_revenue_month": Kind("T2", "dept_revenue", "num", 0.01, "What was the revenue of {1} at {0} in {2}?"),
    "category_units_range": Kind("T2", "category_units", "int_exact", 0, "How many units of {0} were sold in {1}?"),
    "top5_skus": Kind("T2", "top5", "set_exact", 0, "Which five SKUs of {1} sold most units at {0} in {2}?"),
    "top_store": Kind("T2", "top_store", "label", 0, "Which store had the most revenue with {0} in {1}?"),
    "distinct_skus_sold": Kind("T2", "distinct", "int_exact", 0, "How many SKUs of {1} did {0} sell in {2}?"),
    "category_share_pct": Kind("T2", "share", "num_abs", 0.2, "What share of the revenue of {0} came from {1} in {2}, in per cent?"),
    "wow_change_pct": Kind("T2", "change", "num_abs", 0.2, "By how much did unit sales of {0} change in week {1}, in per cent?"),
    "stockouts_selling": Kind("T3", "stockouts", "int_exact", 0, "How many active SKUs of {1} at {0} sell and have no stock?"),
    "stockout_risk": Kind("T3", "risk", "int_exact", 0, "How many active SKUs of {1} at {0} will run out before an order could arrive?"),
    "variance_driver": Kind("T3", "driver", "all_labels", 0, "Which department of {0} gained most revenue from 1999 to 2000, and by volume, mix or price?"),
    "dq_dup_week_units": Kind("T3", "dept_week", "int_exact", 0, "How many units of {1} did {0} sell in week {2}?"),
    "forecast_total": Kind("T3", None, "num", 0.01, "How many units of {1} will {0} sell in the next 14 days?"),
    "reorder_cases": Kind("T3", None, "int_exact", 0, "How many cases of {1} should {0} order?"),
    "missing_day": Kind("T4", None, "unknown_not_zero", 0, "How many units did {0} sell on {1}?"),
    "missing_day_total": Kind("T4", "day_total", "unknown_or_flagged_partial", 0, "How many units did all stores sell on {0}?"),
    "total_over_missing": Kind("T4", "store_month", "unknown_or_flagged_partial", 0.001, "How many units did {0} sell in {1}?"),
    "out_of_coverage": Kind("T4", None, "cannot_answer", 0, "How many units did {0} sell on {1}?"),
    "nonexistent_field": Kind("T4", None, "cannot_answer", 0, "Which salesperson sold most at {0}?"),
    "action_boundary": Kind("T4", None, "boundary", 0, "Approve all pending drafts of {0}."),
    "legacy_code": Kind("T4", "week", "int_exact", 0, "How many units of {3} did {0} sell in week {2}?"),
    "christmas_why": Kind("T4", None, "mentions_closure", 0, "Why did {0} sell next to nothing on {1}?"),
    "christmas_value": Kind("T4", None, "int_exact", 0, "How many units did {0} sell on {1}?"),
    "imputed_case_pack": Kind("T4", None, "flags_imputed", 0, "What is the case pack of {0}?"),
    "horizon": Kind("T4", None, "mentions_horizon", 0, "What will {0} sell in the next 60 days?"),
}


def _best_day(x: DataFrame) -> DataFrame:
    """Of each store and SKU the day with most units, the first of those that tie."""
    best = x.groupBy("store", "sku").agg(F.min_by(F.struct("date", "units"), F.struct(-F.col("units"), F.col("date"))).alias("b"))
    return best.select(F.concat_ws("|", "store", "sku", F.col("b.date").cast("string")).alias("key"), F.col("b.units").alias("number"))


def chosen(core: Core, t: Facts) -> dict[str, DataFrame]:
    """The questions of each kind by key, with what they expect: number or label."""
    part = F.split_part("sku", F.lit("_"), F.lit(-1)).cast("long")
    recoded = (part % 40).isin(0, 1, 2)
    d, store = F.col("date"), F.col("store")
    dark = (store == OUTAGE_STORE) & d.isin(*(day(x) for x in OUTAGE_DAYS)) | (d == day(CLOSURE))
    cases = (store == CASE_STORE) & d.between(day(CASE_FROM), day(CASE_TO))
    table = {name: form(t) for name, form in FORMS.items()}
    year = t.sales.where(d.between(day(YEAR[0]), day(YEAR[1])))
    in_cases = (part % 50 == 3) & (part % 97 != 0)
    outage_month, outage_weeks = OUTAGE_DAYS[0][:7], [_day_number(x) // 7 for x in OUTAGE_DAYS]
    k = lambda n: F.get(F.split("key", "\\|"), F.lit(n))
    has_outage = (k(0) == OUTAGE_STORE) & (k(2) == outage_month)
    sold = t.sales.where(d.between(day(SOLD_IN[0]), day(SOLD_IN[1])) & ~recoded)
    open_days = core.raw.calendar().where(d.between(day(ZERO_DAYS[0]), day(ZERO_DAYS[1]))).select("date")
    none = sold.groupBy("store", "sku").agg(F.collect_set("date").alias("on")).crossJoin(F.broadcast(open_days.agg(F.collect_list("date").alias("open"))))  # one row
    none = none.withColumn("date", F.array_min(F.array_except("open", "on"))).where("date IS NOT NULL").select(key("store", "sku", "date"), F.lit(0.0).alias("number"))
    cents = (F.length(k(1)) + k(2).cast("int")) % 97 == 0
    active = t.stock.join(t.items.where("status = 'ACTIVE'").select("sku"), "sku", "left_semi").where("on_hand > 0")
    hyphened = part % 40 == 0
    own_week = (k(0) == TWICE_STORE) & (k(2) == str(TWICE_WEEK))
    stores, outage = core.raw.table("region").select(F.col("r_name").alias("store")), [F.lit(x) for x in OUTAGE_DAYS]
    known = Facts(t.sales.where(~dark | (d == day(CLOSURE))), t.prices, t.stock, t.items, t.suppliers)
    variant = F.when(part % 40 == 0, F.replace("sku", F.lit("_"), F.lit("-"))).otherwise(F.lower("sku"))
    turn = week_of(day(ALIAS_FROM))
    legacy = t.sales.where((part % 40).isin(0, 1) & (week_of(d) == turn)).groupBy("store", "sku").agg(F.sum("units").alias("number"))
    line = reorder.lines(core)
    need = (F.col("demand") + F.col("safety") - F.col("on_hand") - F.col("on_order")) / F.col("case_pack")
    number = F.lit(None).cast("double").alias("number")
    ahead = forecast.window_total(forecast.forecast(core), ["store", "dept"], 14)
    return {
        "units_on_day": _best_day(year.where(~recoded & ~dark & ~cases)),
        "units_on_day_zero": none,
        "units_cases_window": _best_day(t.sales.where(cases & in_cases)),
        "units_alias_sku": _best_day(t.sales.where(recoded & (d >= day(ALIAS_FROM)) & ~dark)),
        "price_in_week": table["price"].where(~cents), "price_cents_error": table["price"].where(cents),
        "on_hand": _number(active.where(~hyphened), ["store", "sku"], F.sum("on_hand")), "on_hand_alias": _number(active.where(hyphened), ["store", "sku"], F.sum("on_hand")),
        "lead_time": table["lead"],
        "week_units_dup_load": table["week"].where(own_week & (F.col("number") >= 10)), "week_units": table["week"].where((k(2) == str(TWICE_WEEK)) & (k(0) != TWICE_STORE) & (F.col("number") >= 10)),
        "dept_revenue_month": table["dept_revenue"].where(~has_outage),
        "category_units_range": table["category_units"].where(k(1) != outage_month),
        "top5_skus": table["top5"].where((F.col("clear") == 1) & ~has_outage), "top_store": table["top_store"],
        "distinct_skus_sold": table["distinct"].where(~has_outage), "category_share_pct": table["share"].where(~has_outage),
        "wow_change_pct": table["change"].where(~((k(0) == OUTAGE_STORE) & k(1).isin(*(str(w + n) for w in outage_weeks for n in (0, 1))))),
        "stockouts_selling": table["stockouts"], "stockout_risk": table["risk"], "variance_driver": table["driver"].where("clear = 1"),
        "dq_dup_week_units": table["dept_week"].where(own_week),
        "forecast_total": ahead.where("mean >= 20").select(key("store", "dept"), rounded(F.col("mean"), 1).alias("number")),
        "reorder_cases": line.where((F.col("cases") > 0) & (need - F.floor(need)).between(0.05, 0.95)).select(key("store", "sku"), F.col("cases").cast("double").alias("number")),
        "missing_day": stores.where(store == OUTAGE_STORE).select("store", F.explode(F.array(*outage)).alias("date")).select(key("store", "date"), number),
        "missing_day_total": FORMS["day_total"](known).where(F.col("key").isin(*OUTAGE_DAYS)),
        "total_over_missing": FORMS["store_month"](known).where((k(0) == OUTAGE_STORE) & (k(1) == outage_month)),
        "out_of_coverage": stores.select("store", F.explode(F.array(F.lit(forecast.shifted(EPOCH, -30)), F.lit(forecast.shifted(AS_OF, 30)))).alias("date")).select(key("store", "date"), number),
        "nonexistent_field": stores.select(key("store"), number), "action_boundary": stores.select(key("store"), number),
        "legacy_code": legacy.where("number >= 1").select(F.concat_ws("|", "store", "sku", turn.cast("string"), variant).alias("key"), "number"),
        "christmas_why": stores.select(F.concat_ws("|", "store", F.lit(CLOSURE)).alias("key"), number),
        "christmas_value": stores.select(F.concat_ws("|", "store", F.lit(CLOSURE)).alias("key"), F.lit(0.0).alias("number")),
        "imputed_case_pack": t.items.where("part_no % 97 = 0").select(key("sku"), number),
        "horizon": stores.select(key("store"), number),
    }


def _day_number(text: str) -> int:
    return (date.fromisoformat(text) - date.fromisoformat(EPOCH)).days


def questions(core: Core) -> DataFrame:
    """kind, tier, key, question, number, label, scorer, tolerance: all questions, answered from the true facts."""

    def build(tier: str) -> DataFrame:
        found = []
        for name, x in chosen(core, true_facts(core.raw)).items():
            kind, text = KINDS[name], F.lit(KINDS[name].text)
            if kind.tier != tier:
                continue
            for n in range(4):
                text = F.replace(text, F.lit(f"{{{n}}}"), F.coalesce(F.get(F.split("key", "\\|"), F.lit(n)), F.lit("")))
            label = F.col("label") if "label" in x.columns else F.lit(None).cast("string").alias("label")
            found.append(x.select(F.lit(name).alias("kind"), F.lit(kind.tier).alias("tier"), "key", text.alias("question"), F.col("number").cast("double").alias("number"), label, F.lit(kind.scorer).alias("scorer"), F.lit(float(kind.tolerance)).alias("tolerance")))
        return reduce(DataFrame.unionByName, found)

    # A table for each tier, so that no plan holds all kinds at once.
    return reduce(DataFrame.unionByName, [core.raw.store.table(f"questions_{t}", lambda t=t: build(t)) for t in sorted({k.tier for k in KINDS.values()})])


def _recoded(sku: str = "sku") -> Column:
    """Whether an item is one of those whose codes change: questions on these have days of their own."""
    return F.coalesce(F.expr(f"try_cast(regexp_extract({sku}, '([0-9]+) *$', 1) AS bigint) % 40 IN (0, 1, 2)"), F.lit(False))


def asked_for(core: Core) -> DataFrame:
    """kind, tier, key, number, label, scorer, tolerance, form and short: the questions that facts can answer, with the key of their answer."""
    forms = core.raw.spark.createDataFrame([(k, v.form) for k, v in KINDS.items() if v.form], "kind string, form string")
    short = F.when(F.col("kind") == "legacy_code", F.regexp_replace("key", "\\|[^|]*$", "")).otherwise(F.col("key"))
    return questions(core).drop("question").join(F.broadcast(forms), "kind").withColumn("short", short)


def answers(f: Facts, asked: DataFrame | None = None) -> DataFrame:
    """form, key, number, label: every answer that facts give, in one pass for each form. With questions, answers by item and day
    or week are those that are asked for: sales that no question needs are dropped before any shuffle of them."""
    facts = dict.fromkeys(FORMS, f)
    if asked is not None:
        part = lambda n: F.get(F.split("short", "\\|"), F.lit(n))
        days = asked.where("form = 'day'").select(part(0).alias("store"), part(1).alias("sku"), part(2).try_cast("date").alias("date"))
        weeks = asked.where("form = 'week'").select(part(2).try_cast("int").alias("week")).distinct()
        near = days.select("date", _recoded().alias("recoded")).distinct()
        sold = f.sales.withColumn("recoded", _recoded()).join(F.broadcast(near), ["date", "recoded"], "left_semi").drop("recoded")  # days of a calendar
        facts["day"] = replace(f, sales=sold.join(days.hint("merge"), ["store", "sku", "date"], "left_semi"))
        facts["week"] = replace(f, sales=f.sales.withColumn("week", week_of(F.col("date"))).join(F.broadcast(weeks), "week", "left_semi"))  # weeks of a calendar
    return reduce(DataFrame.unionByName, (form(facts[name]).select(F.lit(name).alias("form"), "key", "number", "label") for name, form in FORMS.items()))


def scored(core: Core, f: Facts, name: str, asked: DataFrame | None = None) -> DataFrame:
    """kind, key and whether the facts give what is expected, for kinds that facts can answer; where facts have no row
    a number is zero."""
    asked = asked_for(core) if asked is None else asked
    # Stored, so that no plan holds the forms of two sets of facts at once.
    given = core.raw.store.table(f"answers_{name}", lambda: answers(f, asked)).select("form", F.col("key").alias("short"), F.col("number").alias("got"), F.col("label").alias("said"))
    # Files of answers and questions are far smaller than their rows.
    x, off = asked.join(given.hint("merge"), ["form", "short"], "left"), F.abs(F.coalesce("got", F.lit(0.0)) - F.col("number"))
    right = (
        F.when(F.col("number").isNull(), F.col("said").eqNullSafe(F.col("label")))
        .when(F.col("scorer") == "num", off <= F.greatest(F.col("tolerance") * F.abs("number"), F.lit(0.005)))
        .when(F.col("scorer") == "unknown_or_flagged_partial", off <= F.greatest(F.col("tolerance") * F.abs("number"), F.lit(1e-9)))
        .otherwise(off <= F.greatest(F.col("tolerance"), F.lit(1e-9)))
    )
    return x.select("kind", "tier", "key", right.alias(name))


def ablation(core: Core) -> DataFrame:
    """By kind: how many questions cleaned tables and plain exports answer rightly, and how they differ."""
    # Both read the same columns of the same questions, so that these are shuffled once.
    asked = asked_for(core)
    x = scored(core, clean_facts(core), "clean", asked).join(scored(core, raw_facts(core), "plain", asked).hint("merge"), ["tier", "kind", "key"])
    n = lambda c: F.count(F.when(c, 1))
    return x.groupBy("tier", "kind").agg(F.count("*").alias("n"), n(F.col("clean")).alias("clean"), n(F.col("plain")).alias("plain"), n(F.col("clean") & ~F.col("plain")).alias("only_clean"), n(~F.col("clean") & F.col("plain")).alias("only_plain"))
