"""The question set, its scores, and the same in SQL for a second engine."""

from __future__ import annotations

from supplylens.operators import questions as q
from supplylens.operators.clean import core
from supplylens.queries.oracle import STEPS, sql
from supplylens.sources import standin as s

QUERIES = {
    "question_set": lambda sp, d: q.questions(core(sp, d)),
    "question_ablation": lambda sp, d: q.ablation(core(sp, d)),
}

WEEK = f"CAST((date - DATE '{s.EPOCH}') // 7 AS INTEGER)"
YEAR = f"date BETWEEN DATE '{q.YEAR[0]}' AND DATE '{q.YEAR[1]}'"
MONTH = "strftime(date, '%Y-%m')"
PART = "CAST(regexp_extract(sku, '[0-9]+$') AS BIGINT)"


def two(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


SOURCES = {
    "true": {
        "sales": "SELECT date, store, sku, dept, category, sum(units) AS units FROM lines GROUP BY ALL", "prices": "SELECT * FROM price_true", "stock": "SELECT store, sku, on_hand, on_order FROM stock",
        "items": f"""SELECT p.sku, dept, category, part_no, part_no % (SELECT count(*) FROM supplier) AS supplier_id, CASE WHEN last_date >= DATE '{s.AS_OF}' - 365 THEN 'ACTIVE' ELSE 'DISCONTINUED' END AS status FROM parts p LEFT JOIN last_sale l ON l.sku = p.sku""",
    },
    "clean": {
        "sales": "SELECT f.date, f.store, f.sku, k.dept, k.category, CAST(f.units AS DOUBLE) AS units FROM fact f JOIN dim_sku k USING (sku)", "prices": "SELECT store, dept, week, price FROM price_clean", "stock": "SELECT * FROM inventory",
        "items": "SELECT sku, dept, category, supplier_id, status FROM dim_sku",
    },
    "plain": {
        "sales": "SELECT x.*, m.dept, m.category FROM (SELECT txn_date AS date, store_code AS store, sku_code AS sku, sum(qty) AS units FROM sales_lines GROUP BY ALL) x LEFT JOIN sku_master m ON m.sku_code = x.sku", "prices": "SELECT * FROM price_book",
        "stock": "SELECT store, sku_code AS sku, on_hand, on_order FROM inventory_raw", "items": "SELECT sku_code AS sku, dept, category, supplier_id, 'ACTIVE' AS status FROM sku_master",
    },
}


def answers(f: str) -> str:
    """form, key, number, label, clear: what facts give."""
    sales, rev, stock = f"facts_{f}_sales", f"facts_{f}_revenue", f"facts_{f}_rates"

    def sums(form: str, keys: list[str], value: str, table: str = sales, where: str = "true") -> str:
        return f"SELECT '{form}' AS form, concat_ws('|', {', '.join(keys)}) AS key, {two(f'CAST({value} AS DOUBLE)')} AS number, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS INTEGER) AS clear FROM {table} WHERE {where} GROUP BY {', '.join(keys)}"

    driver = f"""SELECT 'driver', store, NULL, dept || ', ' || name, CAST(change > 0 AND change >= 1.2 * greatest(coalesce(second, 0), 0) AND size >= 1.5 * next_size AS INTEGER)
        FROM (SELECT *, row_number() OVER (PARTITION BY store, dept ORDER BY size DESC, name DESC) AS k, lead(size) OVER (PARTITION BY store, dept ORDER BY size DESC, name DESC) AS next_size
          FROM (SELECT store, dept, change, place, second, unnest(['volume', 'mix', 'price']) AS name, unnest([abs(volume), abs(mix), abs(price)]) AS size FROM facts_{f}_moves)) WHERE k = 1 AND place = 1"""
    return " UNION ALL ".join(
        [
            sums("day", ["store", "sku", "CAST(date AS VARCHAR)"], "sum(units)"), sums("price", ["store", "dept", "week"], "max(price)", f"facts_{f}_prices"), sums("stock", ["store", "sku"], "sum(on_hand)", f"facts_{f}_stock"),
            sums("lead", ["sku"], "max(lead_time_days)", f"facts_{f}_items JOIN suppliers USING (supplier_id)"), sums("week", ["store", "sku", WEEK], "sum(units)"), sums("dept_revenue", ["store", "dept", MONTH], "sum(revenue)", rev, YEAR),
            sums("category_units", ["category", MONTH], "sum(units)", where=f"{YEAR} AND category IS NOT NULL"), sums("distinct", ["store", "dept", MONTH], "count(DISTINCT sku)", where=f"{YEAR} AND dept IS NOT NULL"),
            f"""SELECT 'top5', concat_ws('|', store, dept, month), NULL, string_agg(sku, ', ' ORDER BY sku), max(CASE WHEN place = 5 THEN CAST(units <> coalesce(next, 0) AS INTEGER) END) FROM (SELECT *, row_number() OVER w AS place, lead(units) OVER w AS next
                FROM (SELECT store, dept, {MONTH} AS month, sku, sum(units) AS units FROM {sales} WHERE {YEAR} AND dept IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY store, dept, month ORDER BY units DESC, sku)) WHERE place <= 5 GROUP BY store, dept, month""",
            f"SELECT 'top_store', concat_ws('|', category, month), NULL, store, NULL FROM (SELECT category, {MONTH} AS month, store, {two('sum(revenue)')} AS revenue FROM {rev} WHERE {YEAR} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY category, month ORDER BY revenue DESC, store DESC) = 1",
            f"SELECT 'share', concat_ws('|', store, category, month), {two('100 * v / nullif(sum(v) OVER (PARTITION BY store, month), 0)')}, NULL, NULL FROM (SELECT store, {MONTH} AS month, category, sum(revenue) AS v FROM {rev} WHERE {YEAR} GROUP BY ALL)",
            f"SELECT 'change', concat_ws('|', a.store, a.week), {two('100 * (a.now - b.now) / nullif(b.now, 0)')}, NULL, NULL FROM facts_{f}_weeks a JOIN facts_{f}_weeks b ON b.store = a.store AND b.week = a.week - 1",
            sums("stockouts", ["store", "dept"], "count(CASE WHEN on_hand = 0 AND rate > 0 THEN 1 END)", stock), sums("risk", ["store", "dept"], "count(CASE WHEN on_hand > 0 AND rate > 0 AND (on_hand + on_order) / nullif(rate, 0) < lead_time_days THEN 1 END)", stock), driver,
            sums("dept_week", ["store", "dept", WEEK], "sum(units)", where="dept IS NOT NULL"), sums("store_month", ["store", MONTH], "sum(units)", where=YEAR), sums("day_total", ["CAST(date AS VARCHAR)"], "sum(units)"), sums("store_day", ["store", "CAST(date AS VARCHAR)"], "sum(units)"),
        ]
    )


for name, tables in SOURCES.items():
    for table, text in tables.items():
        STEPS[f"facts_{name}_{table}"] = text
    STEPS[f"facts_{name}_revenue"] = f"SELECT x.*, {two('x.units * p.price')} AS revenue FROM (SELECT *, {WEEK} AS week FROM facts_{name}_sales) x JOIN facts_{name}_prices p ON p.store = x.store AND p.dept = x.dept AND p.week = x.week"
    STEPS[f"facts_{name}_weeks"] = f"SELECT store, {WEEK} AS week, sum(units) AS now FROM facts_{name}_sales WHERE {YEAR} GROUP BY ALL"
    STEPS[f"facts_{name}_rates"] = f"""SELECT i.store, k.dept, i.on_hand, i.on_order, p.lead_time_days, coalesce(u.u, 0) / 365.0 AS rate FROM facts_{name}_stock i JOIN facts_{name}_items k ON k.sku = i.sku AND k.status = 'ACTIVE' JOIN suppliers p ON p.supplier_id = k.supplier_id
        LEFT JOIN (SELECT store, sku, sum(units) AS u FROM facts_{name}_sales WHERE date > DATE '{s.AS_OF}' - 365 AND date <= DATE '{s.AS_OF}' GROUP BY ALL) u ON u.store = i.store AND u.sku = i.sku"""
    STEPS[f"facts_{name}_moves"] = f"""SELECT *, row_number() OVER w AS place, lead(change) OVER w AS second FROM (SELECT store, dept, floor((sum(r_b) - sum(r_a)) * 100 + 0.500001) / 100 AS change,
          floor(CASE WHEN sum(q_a) > 0 THEN (sum(q_b) - sum(q_a)) * (sum(r_a) / sum(q_a)) ELSE sum(q_b * p_a) END * 100 + 0.500001) / 100 AS volume, floor(CASE WHEN sum(q_a) > 0 THEN sum(q_b * p_a) - sum(q_b) * (sum(r_a) / sum(q_a)) ELSE 0.0 END * 100 + 0.500001) / 100 AS mix, floor((sum(r_b) - sum(q_b * p_a)) * 100 + 0.500001) / 100 AS price
          FROM (SELECT *, coalesce(r_a / nullif(q_a, 0), r_b / nullif(q_b, 0), 0.0) AS p_a FROM (SELECT store, dept, sku, coalesce(sum(units) FILTER (WHERE year(date) = 1999), 0) AS q_a, coalesce(sum(revenue) FILTER (WHERE year(date) = 1999), 0) AS r_a,
            coalesce(sum(units) FILTER (WHERE year(date) = 2000), 0) AS q_b, coalesce(sum(revenue) FILTER (WHERE year(date) = 2000), 0) AS r_b FROM facts_{name}_revenue WHERE year(date) IN (1999, 2000) GROUP BY ALL)) GROUP BY ALL) WINDOW w AS (PARTITION BY store ORDER BY change DESC, dept)"""
    STEPS[f"answers_{name}"] = answers(name)

OUT = f"store = '{s.OUTAGE_STORE}' AND date IN (DATE '{s.OUTAGE_DAYS[0]}', DATE '{s.OUTAGE_DAYS[1]}')"
DARK = f"({OUT} OR date = DATE '{s.CLOSURE}')"
CASES = f"(store = '{s.CASE_STORE}' AND date BETWEEN DATE '{s.CASE_FROM}' AND DATE '{s.CASE_TO}')"
RECODED = f"{PART} % 40 IN (0, 1, 2)"
LOST = s.OUTAGE_DAYS[0][:7]
WEEKS = sorted({q._day_number(x) // 7 + n for x in s.OUTAGE_DAYS for n in (0, 1)})
STEPS["keyed"] = "SELECT form, key, number, label, clear, str_split(key, '|') AS k FROM answers_true"
NO_OUTAGE = f"NOT (k[1] = '{s.OUTAGE_STORE}' AND k[3] = '{LOST}')"


def best(where: str) -> str:
    return f"SELECT concat_ws('|', store, sku, CAST(date AS VARCHAR)) AS key, units AS number, NULL AS label FROM (SELECT *, row_number() OVER (PARTITION BY store, sku ORDER BY units DESC, date) AS place FROM facts_true_sales WHERE {where}) WHERE place = 1"


def given(form: str, where: str = "true") -> str:
    return f"SELECT key, number, label FROM keyed WHERE form = '{form}' AND {where}"


TURN = q._day_number(s.ALIAS_FROM) // 7
PER_STORE = "SELECT r_name AS key, NULL AS number, NULL AS label FROM region"
CHOSEN = {
    "units_on_day": best(f"{YEAR} AND NOT {RECODED} AND NOT {DARK} AND NOT {CASES}"),
    "units_on_day_zero": f"""SELECT concat_ws('|', store, sku, CAST(min(date) AS VARCHAR)) AS key, 0 AS number, NULL AS label FROM (SELECT DISTINCT store, sku FROM facts_true_sales WHERE date BETWEEN DATE '{q.SOLD_IN[0]}' AND DATE '{q.SOLD_IN[1]}' AND NOT {RECODED})
        CROSS JOIN (SELECT date FROM calendar WHERE date BETWEEN DATE '{q.ZERO_DAYS[0]}' AND DATE '{q.ZERO_DAYS[1]}') ANTI JOIN facts_true_sales USING (store, sku, date) GROUP BY store, sku""",
    "units_cases_window": best(f"{CASES} AND {PART} % 50 = 3 AND {PART} % 97 <> 0"),
    "units_alias_sku": best(f"{RECODED} AND date >= DATE '{s.ALIAS_FROM}' AND NOT {DARK}"),
    "price_in_week": given("price", "(length(k[2]) + CAST(k[3] AS INTEGER)) % 97 <> 0"), "price_cents_error": given("price", "(length(k[2]) + CAST(k[3] AS INTEGER)) % 97 = 0"),
    **{kind: f"SELECT concat_ws('|', store, sku) AS key, sum(on_hand) AS number, NULL AS label FROM facts_true_stock JOIN (SELECT sku FROM facts_true_items WHERE status = 'ACTIVE') USING (sku) WHERE on_hand > 0 AND {no}({PART} % 40 = 0) GROUP BY store, sku" for kind, no in (("on_hand", "NOT "), ("on_hand_alias", ""))},
    "lead_time": given("lead"),
    "week_units_dup_load": given("week", f"k[1] = '{s.TWICE_STORE}' AND k[3] = '{s.TWICE_WEEK}' AND number >= 10"), "week_units": given("week", f"k[1] <> '{s.TWICE_STORE}' AND k[3] = '{s.TWICE_WEEK}' AND number >= 10"),
    "dept_revenue_month": given("dept_revenue", NO_OUTAGE), "category_units_range": given("category_units", f"k[2] <> '{LOST}'"), "top5_skus": given("top5", f"clear = 1 AND {NO_OUTAGE}"), "top_store": given("top_store"),
    "distinct_skus_sold": given("distinct", NO_OUTAGE), "category_share_pct": given("share", NO_OUTAGE), "wow_change_pct": given("change", f"NOT (k[1] = '{s.OUTAGE_STORE}' AND k[2] IN ({', '.join(repr(str(w)) for w in WEEKS)}))"),
    "stockouts_selling": given("stockouts"), "stockout_risk": given("risk"), "variance_driver": given("driver", "clear = 1"), "dq_dup_week_units": given("dept_week", f"k[1] = '{s.TWICE_STORE}' AND k[3] = '{s.TWICE_WEEK}'"),
    "forecast_total": f"SELECT concat_ws('|', store, dept) AS key, floor(floor(sum(mean) * 10000 + 0.5) / 10000 * 10 + 0.5) / 10 AS number, NULL AS label FROM predicted WHERE date <= DATE '2001-06-02' + 14 GROUP BY store, dept HAVING floor(sum(mean) * 10000 + 0.5) / 10000 >= 20",
    "reorder_cases": """SELECT concat_ws('|', store, sku) AS key, cases AS number, NULL AS label FROM (SELECT *, (floor(d * 10000 + 0.5) / 10000 + floor(sf * 10000 + 0.5) / 10000 - on_hand - on_order) / CAST(case_pack AS DOUBLE) AS need FROM order_lines) WHERE cases > 0 AND need - floor(need) BETWEEN 0.05 AND 0.95""",
    "missing_day": " UNION ALL ".join(f"SELECT '{s.OUTAGE_STORE}|{d}' AS key, NULL AS number, NULL AS label" for d in s.OUTAGE_DAYS),
    "missing_day_total": f"SELECT CAST(date AS VARCHAR) AS key, {two('sum(units)')} AS number, NULL AS label FROM facts_true_sales WHERE date IN (DATE '{s.OUTAGE_DAYS[0]}', DATE '{s.OUTAGE_DAYS[1]}') AND NOT ({OUT}) GROUP BY date",
    "total_over_missing": f"SELECT concat_ws('|', store, '{LOST}') AS key, {two('sum(units)')} AS number, NULL AS label FROM facts_true_sales WHERE store = '{s.OUTAGE_STORE}' AND {MONTH} = '{LOST}' AND NOT ({OUT}) GROUP BY store",
    "out_of_coverage": f"SELECT r_name || '|' || d AS key, NULL AS number, NULL AS label FROM region, (SELECT unnest(['{q.forecast.shifted(s.EPOCH, -30)}', '{q.forecast.shifted(s.AS_OF, 30)}']) AS d)",
    "nonexistent_field": PER_STORE, "action_boundary": PER_STORE, "horizon": PER_STORE,
    "legacy_code": f"""SELECT concat_ws('|', store, sku, '{TURN}', CASE WHEN {PART} % 40 = 0 THEN replace(sku, '_', '-') ELSE lower(sku) END) AS key, sum(units) AS number, NULL AS label FROM facts_true_sales WHERE {PART} % 40 IN (0, 1) AND {WEEK} = {TURN} GROUP BY store, sku HAVING sum(units) >= 1""",
    "christmas_why": f"SELECT r_name || '|{s.CLOSURE}' AS key, NULL AS number, NULL AS label FROM region", "christmas_value": f"SELECT r_name || '|{s.CLOSURE}' AS key, 0 AS number, NULL AS label FROM region",
    "imputed_case_pack": "SELECT sku AS key, NULL AS number, NULL AS label FROM facts_true_items WHERE part_no % 97 = 0",
}


def asked(kind: str) -> str:
    k, text = q.KINDS[kind], "'" + q.KINDS[kind].text.replace("'", "''") + "'"
    for n in range(4):
        text = f"replace({text}, '{{{n}}}', coalesce(str_split(key, '|')[{n + 1}], ''))"
    return f"SELECT '{kind}' AS kind, '{k.tier}' AS tier, key, {text} AS question, CAST(number AS DOUBLE) AS number, CAST(label AS VARCHAR) AS label, '{k.scorer}' AS scorer, CAST({k.tolerance} AS DOUBLE) AS tolerance FROM ({CHOSEN[kind]})"


STEPS["questions"] = " UNION ALL ".join(asked(kind) for kind in CHOSEN)
STEPS["question_forms"] = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{v.form}' AS form" for k, v in q.KINDS.items() if v.form)
RIGHT = """CASE WHEN u.number IS NULL THEN u.label IS NOT DISTINCT FROM a.label WHEN scorer = 'num' THEN abs(coalesce(a.number, 0) - u.number) <= greatest(tolerance * abs(u.number), 0.005)
    WHEN scorer = 'unknown_or_flagged_partial' THEN abs(coalesce(a.number, 0) - u.number) <= greatest(tolerance * abs(u.number), 1e-9) ELSE abs(coalesce(a.number, 0) - u.number) <= greatest(tolerance, 1e-9) END"""
for name in ("clean", "plain"):
    STEPS[f"scored_{name}"] = f"SELECT u.kind, tier, u.key, {RIGHT} AS ok FROM questions u JOIN question_forms g ON g.kind = u.kind LEFT JOIN answers_{name} a ON a.form = g.form AND a.key = CASE WHEN u.kind = 'legacy_code' THEN regexp_replace(u.key, '\\|[^|]*$', '') ELSE u.key END"

ORACLES = {
    "question_set": sql("SELECT kind, tier, key, question, number, label, scorer, tolerance FROM questions"),
    "question_ablation": sql("""SELECT c.tier, c.kind, count(*) AS n, count(*) FILTER (WHERE c.ok) AS clean, count(*) FILTER (WHERE p.ok) AS plain, count(*) FILTER (WHERE c.ok AND NOT p.ok) AS only_clean, count(*) FILTER (WHERE NOT c.ok AND p.ok) AS only_plain
        FROM scored_clean c JOIN scored_plain p ON p.kind = c.kind AND p.key = c.key GROUP BY 1, 2"""),
}
