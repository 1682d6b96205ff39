"""Lookups, anomalies, variance, forecasts and reorders."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded
from supplylens.functions.text import close_codes
from supplylens.operators import anomalies, forecast, lookups, quantile_forecast, reorder, variance
from supplylens.operators.clean import core
from supplylens.plans.run_sql import describe, filter_hints
from supplylens.queries.oracle import sql
from supplylens.sources.standin import AS_OF, Raw

MONTH, YEAR = ("2000-06-01", "2000-06-30"), ("2000-01-01", "2000-12-31")


def zero_days(c):
    """Open store-days of a month on which a department sold nothing: an anti join with the sales."""
    sold = c.fact_sales_daily.join(c.dim_sku.where("dept = 'PROMO'").select("sku"), "sku").select("date", "store").distinct()
    open_days = lookups.between(c.store_day_status, *MONTH).where("status = 'open'").select("date", "store")
    return open_days.join(sold, ["date", "store"], "left_anti")


def lead_times(c):
    return c.dim_sku.where("dept = 'PROMO'").join(c.raw.suppliers(), "supplier_id").select("sku", "supplier_id", "lead_time_days", "min_order_cases")


def top_store(c):
    """The store with the most revenue of a year, and its lead over the next."""
    x = lookups.total(lookups.between(c.sales_enriched, *YEAR), ["store"], "revenue", "revenue")
    ranked = F.sort_array(F.collect_list(F.struct("revenue", "store")), asc=False)  # a few stores
    return x.agg(ranked.alias("r")).select(F.col("r")[0]["store"].alias("store"), F.col("r")[0]["revenue"].alias("revenue"), rounded(F.col("r")[0]["revenue"] - F.try_element_at("r", F.lit(2))["revenue"]).alias("margin"))


def selling(c, days=365):
    """Units a day over a fixed number of days, for stock that has any."""
    u = lookups.last_days(c.fact_sales_daily, AS_OF, days).groupBy("store", "sku").agg(F.sum("units").alias("u"))
    return c.inventory.join(u, ["store", "sku"]).withColumn("per_day", F.col("u").cast("double") / float(days))


def risk(c, days=365):
    x = selling(c, days).join(c.dim_sku.select("sku", "supplier_id"), "sku").join(c.raw.suppliers().select("supplier_id", "lead_time_days"), "supplier_id")
    x = x.where((F.col("on_hand") > 0) & ((F.col("on_hand") + F.col("on_order")) / F.nullif(F.col("per_day"), F.lit(0.0)) < F.col("lead_time_days")))
    return x.select("store", "sku", "on_hand", "on_order", "lead_time_days", rounded(F.col("per_day"), 6).alias("per_day"))


def over_missing(c):
    """Totals of a window with the number of days they lack."""
    x = lookups.between(c.store_day_status, "2000-05-01", "2000-05-31")
    return x.groupBy("store").agg(F.sum("units").alias("known_units"), F.count(F.when(F.col("status") == "missing_data", 1)).alias("missing_days"))


def spellings(c):
    """Codes as exports have them, as people write them, and some that no SKU has."""
    parts, no = c.raw.parts(), F.col("part_no").cast("string")
    said = parts.select(F.explode(F.array(F.concat(F.lower("dept"), F.lit(" "), no), F.concat("dept", no))).alias("code"))
    return c.raw.sales_lines().select(F.col("sku_code").alias("code")).union(said).distinct()


QUERIES = {
    "units_on_day": lambda s, d: lookups.between(core(s, d).fact_sales_daily, "2000-03-15", "2000-03-15").groupBy("store").agg(F.sum("units").alias("units")),
    "zero_sale_days": lambda s, d: zero_days(core(s, d)),
    "price_in_week": lambda s, d: core(s, d).fact_price_weekly.where("week = 260").select("store", "dept", "price", "is_imputed"),
    "on_hand": lambda s, d: core(s, d).inventory.where(F.col("sku").like("PROMO%")),
    "lead_time": lambda s, d: lead_times(core(s, d)),
    "week_units": lambda s, d: core(s, d).sales_enriched.where("week between 298 and 302").groupBy("store", "week").agg(F.sum("units").alias("units")),
    "dept_revenue_month": lambda s, d: lookups.total(lookups.between(core(s, d).sales_enriched, *YEAR).withColumn("month", F.month("date")), ["dept", "month"], "revenue", "revenue"),
    "category_units_range": lambda s, d: lookups.between(core(s, d).sales_enriched, "2000-02-10", "2000-04-20").groupBy("category").agg(F.sum("units").alias("units")),
    "top5_skus": lambda s, d: lookups.top_k(lookups.between(core(s, d).fact_sales_daily, *YEAR).groupBy("sku").agg(F.sum("units").alias("units")), "sku", "units", 5),
    "top_store": lambda s, d: top_store(core(s, d)),
    "distinct_skus_sold": lambda s, d: lookups.between(core(s, d).sales_enriched, *YEAR).groupBy("store", "dept").agg(F.countDistinct("sku").alias("skus")),
    "category_share_pct": lambda s, d: lookups.share(lookups.between(core(s, d).sales_enriched, *YEAR), ["store"], "dept", "revenue"),
    "wow_change_pct": lambda s, d: lookups.change(core(s, d).sales_enriched.where("week between 280 and 300"), ["store"], "week", "units"),
    "stockouts_selling": lambda s, d: selling(core(s, d)).where("on_hand = 0").select("store", "sku", rounded(F.col("per_day"), 6).alias("per_day")),
    "stockout_risk": lambda s, d: risk(core(s, d)),
    "stockouts_selling_month": lambda s, d: selling(core(s, d), 28).where("on_hand = 0").select("store", "sku", rounded(F.col("per_day"), 6).alias("per_day")),
    "stockout_risk_month": lambda s, d: risk(core(s, d), 28),
    "total_over_missing": lambda s, d: over_missing(core(s, d)),
    "describe_tables": lambda s, d: describe(core(s, d)),
    "limit_truncation": lambda s, d: lookups.truncated(Raw(s, d).parts(), 50),
    "filter_hint_case": lambda s, d: filter_hints(core(s, d).dim_sku, "status", "active"),
    "sku_close_matches": lambda s, d: close_codes(core(s, d).dim_sku, "sku", "PROM_47", 5),
    "sku_spellings": lambda s, d: lookups.spelled(spellings(core(s, d)), core(s, d).dim_sku),
    "describe_raw": lambda s, d: describe(core(s, d), "raw"),
    "inventory_anomalies": lambda s, d: anomalies.inventory_anomalies(core(s, d), window=365),
    "inventory_anomalies_month": lambda s, d: anomalies.inventory_anomalies(core(s, d)),
    "inventory_anomaly_summary": lambda s, d: anomalies.inventory_anomalies(core(s, d), window=365).groupBy("anomaly").agg(F.count("*").alias("n"), rounded(F.sum("value"), 0).alias("value")),
    "sales_anomaly_weeks": lambda s, d: anomalies.week_anomalies(core(s, d)),
    "sku_stop_spike": lambda s, d: anomalies.sku_anomalies(core(s, d), scale=8, stopped=0.05),
    "sku_stop_spike_week": lambda s, d: anomalies.sku_anomalies(core(s, d)),
    "sales_anomalies": lambda s, d: anomalies.sales_anomalies(core(s, d), scale=8, stopped=0.05),
    "sales_anomalies_week": lambda s, d: anomalies.sales_anomalies(core(s, d)),
    "variance_dept": lambda s, d: variance.variance(core(s, d), "dept"),
    "variance_category": lambda s, d: variance.variance(core(s, d), "category"),
    "variance_store": lambda s, d: variance.explain(variance.by_sku(core(s, d), "dept"), ["store"]),
    "variance_sku": lambda s, d: variance.explain(variance.by_sku(core(s, d), "dept"), ["sku"]),
    "variance_total": lambda s, d: variance.totals(core(s, d)),
    "variance_pivot": lambda s, d: variance.pivoted(core(s, d)),
    "variance_driver": lambda s, d: variance.driver(core(s, d)),
    "forecast_features": lambda s, d: forecast.features(core(s, d)),
    "weekday_baseline": lambda s, d: forecast.weekday_baseline(core(s, d)),
    "velocity_bands": lambda s, d: forecast.bands(core(s, d)),
    "forecast_order_repair": lambda s, d: forecast.forecast(core(s, d)),
    "backtest_metrics": lambda s, d: forecast.metrics(core(s, d)),
    "wape": lambda s, d: forecast.with_actuals(core(s, d), forecast.forecast(core(s, d))).agg(rounded(forecast.wape(F.col("actual"), F.col("mean")), 6).alias("wape")),
    "forecast_one_store": lambda s, d: forecast.window_total(forecast.forecast(core(s, d)).where("store = 'ASIA'"), ["store", "dept"], 14),
    "forecast_all_stores": lambda s, d: forecast.window_total(forecast.forecast(core(s, d)), ["dept"], 14),
    "model_forecast": lambda s, d: forecast.model_forecast(core(s, d)),
    "quantile_forecast": lambda s, d: quantile_forecast.forecast(core(s, d)).drop("units"),
    "quantile_backtest": lambda s, d: quantile_forecast.metrics(core(s, d)),
    "reorder_lines": lambda s, d: reorder.lines(core(s, d)),
    "reorder_drafts": lambda s, d: reorder.drafts(reorder.lines(core(s, d))),
    "draft_state_fold": lambda s, d: reorder.fold(*reorder.stand_in_decisions(Raw(s, d))),
}
EFFECTS = """CAST(sum(q_a) AS BIGINT) AS units_a, CAST(sum(q_b) AS BIGINT) AS units_b, floor(sum(r_a) * 100 + 0.5) / 100 AS revenue_a, floor(sum(r_b) * 100 + 0.5) / 100 AS revenue_b,
 floor(CASE WHEN sum(q_a) > 0 THEN (sum(q_b) - sum(q_a)) * (sum(r_a) / nullif(CAST(sum(q_a) AS DOUBLE), 0)) ELSE sum(q_b * p_a) END * 100 + 0.500001) / 100 AS volume,
 floor(CASE WHEN sum(q_a) > 0 THEN sum(q_b * p_a) - sum(q_b) * (sum(r_a) / nullif(CAST(sum(q_a) AS DOUBLE), 0)) ELSE 0.0 END * 100 + 0.500001) / 100 AS mix,
 floor((sum(r_b) - sum(q_b * p_a)) * 100 + 0.500001) / 100 AS price, floor((sum(r_b) - sum(r_a)) * 100 + 0.500001) / 100 AS change"""
BY_DEPT = f"SELECT dept AS grp, {EFFECTS} FROM sku_prices GROUP BY dept"
SALES = "store, subject, level, anomaly, this_week, base_mean, pct_change, z"
YEAR_SQL, LAST = "date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'", f"date > DATE '{AS_OF}' - 365 AND date <= DATE '{AS_OF}'"
SELLING = f"SELECT i.*, u / 365.0 AS per_day FROM inventory i JOIN (SELECT store, sku, CAST(sum(units) AS DOUBLE) AS u FROM fact WHERE {LAST} GROUP BY 1, 2) x USING (store, sku)"
SELLING_MONTH = SELLING.replace("- 365 AND", "- 28 AND").replace("365.0", "28.0")
WINDOW = "floor(m * 10000 + 0.5) / 10000 AS mean, floor(greatest(m - 1.2816 * sd, 0.0) * 10000 + 0.5) / 10000 AS low, floor((m + 1.2816 * sd) * 10000 + 0.5) / 10000 AS high"
SPAN = "sum(mean) AS m, sqrt(sum(pow((p90 - p10) / 2.5632, 2))) AS sd FROM predicted WHERE date <= DATE '2001-06-02' + 14"
BACK = "PARTITION BY store, dept ORDER BY date ROWS BETWEEN {} PRECEDING AND {} PRECEDING"
SIX = "floor({} * 1000000 + 0.5) / 1000000"

ORACLES = {
    "units_on_day": sql("SELECT store, CAST(sum(units) AS BIGINT) AS units FROM fact WHERE date = DATE '2000-03-15' GROUP BY 1"),
    "zero_sale_days": sql("SELECT date, store FROM day_status ANTI JOIN (SELECT f.date, f.store FROM fact f JOIN dim_sku k ON k.sku = f.sku AND k.dept = 'PROMO') p USING (date, store) WHERE status = 'open' AND date BETWEEN DATE '2000-06-01' AND DATE '2000-06-30'"),
    "price_in_week": sql("SELECT store, dept, price, is_imputed FROM price_clean WHERE week = 260"),
    "on_hand": sql("SELECT * FROM inventory WHERE sku LIKE 'PROMO%'"),
    "lead_time": sql("SELECT sku, supplier_id, lead_time_days, min_order_cases FROM dim_sku JOIN suppliers USING (supplier_id) WHERE dept = 'PROMO'"),
    "week_units": sql("SELECT store, week, CAST(sum(units) AS BIGINT) AS units FROM enriched WHERE week BETWEEN 298 AND 302 GROUP BY 1, 2"),
    "dept_revenue_month": sql(f"SELECT dept, CAST(month(date) AS INTEGER) AS month, floor(sum(revenue) * 100 + 0.5) / 100 AS revenue FROM enriched WHERE {YEAR_SQL} GROUP BY 1, 2"),
    "category_units_range": sql("SELECT category, CAST(sum(units) AS BIGINT) AS units FROM enriched WHERE date BETWEEN DATE '2000-02-10' AND DATE '2000-04-20' GROUP BY 1"),
    "top5_skus": sql(f"SELECT sku, units, rank, rank = 5 AND next IS NOT DISTINCT FROM units AS tied_at_cut FROM (SELECT *, row_number() OVER (ORDER BY units DESC, sku) AS rank, lead(units) OVER (ORDER BY units DESC, sku) AS next FROM (SELECT sku, CAST(sum(units) AS BIGINT) AS units FROM fact WHERE {YEAR_SQL} GROUP BY 1)) WHERE rank <= 5"),
    "top_store": sql(f"SELECT store, revenue, floor((revenue - next) * 100 + 0.5) / 100 AS margin FROM (SELECT *, lead(revenue) OVER (ORDER BY revenue DESC, store DESC) AS next, row_number() OVER (ORDER BY revenue DESC, store DESC) AS k FROM (SELECT store, floor(sum(revenue) * 100 + 0.5) / 100 AS revenue FROM enriched WHERE {YEAR_SQL} GROUP BY 1)) WHERE k = 1"),
    "distinct_skus_sold": sql(f"SELECT store, dept, count(DISTINCT sku) AS skus FROM enriched WHERE {YEAR_SQL} GROUP BY 1, 2"),
    "category_share_pct": sql(f"SELECT store, dept, floor(100 * v / sum(v) OVER (PARTITION BY store) * 10000 + 0.5) / 10000 AS share_pct FROM (SELECT store, dept, sum(revenue) AS v FROM enriched WHERE {YEAR_SQL} GROUP BY 1, 2)"),
    "wow_change_pct": sql("SELECT a.store, a.week, a.u AS now, b.u AS prior, floor(100 * (a.u - b.u) / nullif(CAST(b.u AS DOUBLE), 0) * 10000 + 0.5) / 10000 AS change_pct FROM (SELECT store, week, CAST(sum(units) AS BIGINT) AS u FROM enriched WHERE week BETWEEN 280 AND 300 GROUP BY 1, 2) a LEFT JOIN (SELECT store, week, CAST(sum(units) AS BIGINT) AS u FROM enriched WHERE week BETWEEN 280 AND 300 GROUP BY 1, 2) b ON b.store = a.store AND b.week = a.week - 1"),
    "stockouts_selling": sql(f"SELECT store, sku, {SIX.format('per_day')} AS per_day FROM ({SELLING}) WHERE on_hand = 0"),
    "stockout_risk": sql(f"SELECT x.store, x.sku, x.on_hand, x.on_order, p.lead_time_days, {SIX.format('x.per_day')} AS per_day FROM ({SELLING}) x JOIN dim_sku k ON k.sku = x.sku JOIN suppliers p ON p.supplier_id = k.supplier_id WHERE x.on_hand > 0 AND (x.on_hand + x.on_order) / nullif(x.per_day, 0) < p.lead_time_days"),
    "stockouts_selling_month": sql(f"SELECT store, sku, {SIX.format('per_day')} AS per_day FROM ({SELLING_MONTH}) WHERE on_hand = 0"),
    "stockout_risk_month": sql(f"SELECT x.store, x.sku, x.on_hand, x.on_order, p.lead_time_days, {SIX.format('x.per_day')} AS per_day FROM ({SELLING_MONTH}) x JOIN dim_sku k ON k.sku = x.sku JOIN suppliers p ON p.supplier_id = k.supplier_id WHERE x.on_hand > 0 AND (x.on_hand + x.on_order) / nullif(x.per_day, 0) < p.lead_time_days"),
    "total_over_missing": sql("SELECT store, CAST(sum(units) AS BIGINT) AS known_units, count(*) FILTER (WHERE status = 'missing_data') AS missing_days FROM day_status WHERE date BETWEEN DATE '2000-05-01' AND DATE '2000-05-31' GROUP BY 1"),
    "limit_truncation": sql("SELECT CAST(least(count(*), 50) AS BIGINT) AS n_rows, count(*) > 50 AS truncated FROM (SELECT 1 FROM parts LIMIT 51)"),
    "filter_hint_case": sql("SELECT DISTINCT status AS value, 'differs in case' AS hint FROM dim_sku WHERE lower(status) = 'active' AND status <> 'active'"),
    "sku_close_matches": sql("SELECT sku, floor(jaro_winkler_similarity(sku, 'PROM_47') * 1000000000 + 0.5) / 1000000000 AS similarity FROM dim_sku ORDER BY similarity DESC, sku LIMIT 5"),
    "sku_spellings": sql("""SELECT code, sku, sku IS NOT NULL AND code <> sku AS interpreted FROM (SELECT DISTINCT sku_code AS code FROM sales_lines UNION SELECT lower(dept) || ' ' || part_no FROM parts UNION SELECT dept || part_no FROM parts)
        LEFT JOIN dim_sku ON sku = translate(upper(trim(code)), '- ', '__')"""),
    "inventory_anomalies": sql("SELECT * FROM stock_found"),
    "inventory_anomalies_month": sql("SELECT * FROM month_stock_found"),
    "inventory_anomaly_summary": sql("SELECT anomaly, count(*) AS n, floor(sum(value) + 0.5) AS value FROM stock_found GROUP BY 1"),
    "sales_anomaly_weeks": sql(f"SELECT {SALES} FROM week_found"),
    "sku_stop_spike": sql(f"SELECT {SALES} FROM sku_found"),
    "sku_stop_spike_week": sql(f"SELECT {SALES} FROM week_sku_found"),
    "sales_anomalies_week": sql(f"SELECT {SALES} FROM week_found UNION ALL SELECT {SALES} FROM week_sku_found"),
    "sales_anomalies": sql(f"SELECT {SALES} FROM week_found UNION ALL SELECT {SALES} FROM sku_found"),
    "variance_dept": sql(BY_DEPT),
    "variance_category": sql(f"SELECT category AS grp, {EFFECTS} FROM sku_prices GROUP BY category"),
    "variance_store": sql(f"SELECT store, {EFFECTS} FROM sku_prices GROUP BY store"),
    "variance_sku": sql(f"SELECT sku, {EFFECTS} FROM sku_prices GROUP BY sku"),
    "variance_total": sql(f"SELECT {', '.join(f'floor(sum({c}) * 100 + 0.5) / 100 AS {c}' for c in ('volume', 'mix', 'price', 'change'))} FROM ({BY_DEPT})"),
    "variance_pivot": sql("SELECT k.dept, CAST(sum(units) FILTER (WHERE year(date) = 1999) AS BIGINT) AS a, CAST(sum(units) FILTER (WHERE year(date) = 2000) AS BIGINT) AS b FROM fact JOIN dim_sku k USING (sku) WHERE year(date) IN (1999, 2000) GROUP BY 1"),
    "variance_driver": sql(f"SELECT grp, driver, effect FROM (SELECT grp, driver, effect, row_number() OVER (PARTITION BY grp ORDER BY abs(effect) DESC, driver DESC) AS k FROM (SELECT grp, unnest(['volume', 'mix', 'price']) AS driver, unnest([volume, mix, price]) AS effect FROM ({BY_DEPT}))) WHERE k = 1"),
    "forecast_features": sql(f"""SELECT * FROM (SELECT store, dept, date, units, lag(units, 28) OVER w AS lag_28, lag(units, 35) OVER w AS lag_35, lag(units, 42) OVER w AS lag_42, lag(units, 49) OVER w AS lag_49,
        {SIX.format(f"avg(units) OVER ({BACK.format(34, 28)})")} AS rm7, {SIX.format(f"avg(units) OVER ({BACK.format(55, 28)})")} AS rm28, {SIX.format(f"avg(units) OVER ({BACK.format(83, 28)})")} AS rm56,
        {SIX.format(f"stddev_samp(units) OVER ({BACK.format(55, 28)})")} AS rsd28, {SIX.format(f"avg(CAST(units = 0 AS INTEGER)) OVER ({BACK.format(55, 28)})")} AS zero28, price,
        {SIX.format("(price / avg(price) OVER (PARTITION BY store, dept ORDER BY date ROWS BETWEEN 55 PRECEDING AND CURRENT ROW))")} AS price_rel_8w, {SIX.format("(price / lag(price, 7) OVER w)")} AS price_chg_1w,
        CAST(isodow(date) AS INTEGER) AS dow, CAST(day(date) AS INTEGER) AS dom, CAST(month(date) AS INTEGER) AS month, CAST(snap AS INTEGER) AS snap, CAST(event_type IS NOT NULL AS INTEGER) AS is_event, coalesce(event_type, 'none') AS event_type, CAST(date - first_sale AS INTEGER) AS age_days
        FROM (SELECT g.*, coalesce(p.price, last_value(p.price IGNORE NULLS) OVER (PARTITION BY g.store, g.dept ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS price
          FROM (SELECT * FROM dense WHERE date >= DATE '2001-04-01' - 91) g LEFT JOIN price_clean p ON p.store = g.store AND p.dept = g.dept AND p.week = least(g.week, CAST((DATE '2001-06-02' - DATE '1995-01-01') // 7 AS INTEGER)))
        WINDOW w AS (PARTITION BY store, dept ORDER BY date)) WHERE date >= DATE '2001-04-01'"""),
    "weekday_baseline": sql("SELECT * FROM baseline"),
    "velocity_bands": sql("SELECT * FROM speed_bands"),
    "forecast_order_repair": sql("SELECT * FROM predicted"),
    "backtest_metrics": sql(f"""SELECT level, segment, count(*) AS rows, CAST(sum(actual) AS BIGINT) AS units, {SIX.format("(sum(abs(actual - mean)) / nullif(CAST(sum(actual) AS DOUBLE), 0))")} AS wape, {SIX.format("((sum(mean) - sum(actual)) / nullif(CAST(sum(actual) AS DOUBLE), 0))")} AS bias,
        {SIX.format("avg(CAST(actual < p10 AS INTEGER))")} AS below_p10, {SIX.format("avg(CAST(actual > p90 AS INTEGER))")} AS above_p90
        FROM (SELECT 'overall' AS level, 'all' AS segment, * FROM scored UNION ALL SELECT 'dept', dept, * FROM scored UNION ALL SELECT 'store', store, * FROM scored UNION ALL SELECT 'velocity', band, * FROM scored) GROUP BY 1, 2"""),
    "wape": sql(f"SELECT {SIX.format('(sum(abs(actual - mean)) / nullif(CAST(sum(actual) AS DOUBLE), 0))')} AS wape FROM scored"),
    "forecast_one_store": sql(f"SELECT store, dept, {WINDOW} FROM (SELECT store, dept, {SPAN} AND store = 'ASIA' GROUP BY 1, 2)"),
    "forecast_all_stores": sql(f"SELECT dept, {WINDOW} FROM (SELECT dept, {SPAN} GROUP BY 1)"),
    "reorder_lines": sql("""SELECT store, sku, dept, supplier_id, lead_time_days, min_order_cases, case_pack, floor(d * 10000 + 0.5) / 10000 AS demand, floor(sf * 10000 + 0.5) / 10000 AS safety, on_hand, on_order, cases,
        floor(cases * case_pack * unit_cost * 100 + 0.5) / 100 AS cost FROM order_lines"""),
    "reorder_drafts": sql("""SELECT store, supplier_id, lead_time_days, count(*) AS n_lines, CAST(sum(cases) AS BIGINT) AS cases, floor(sum(floor(cases * case_pack * unit_cost * 100 + 0.5) / 100) * 100 + 0.5) / 100 AS cost, sum(cases) < min_order_cases AS below_minimum, 'PENDING_APPROVAL' AS status
        FROM order_lines WHERE cases > 0 GROUP BY store, supplier_id, lead_time_days, min_order_cases"""),
    "draft_state_fold": """WITH span AS (SELECT min(o_orderkey) AS low, max(o_orderkey) - min(o_orderkey) + 1 AS n FROM orders),
        valid AS (SELECT low + event_id // 3 * 7919 % n AS draft_id, CASE WHEN event_type = 'error' THEN 'REJECTED' ELSE 'APPROVED' END AS status, 'user ' || user_id AS who, ts, event_id
          FROM events, span WHERE event_type IN ('click', 'error', 'purchase') AND user_id % 5 <> 0 AND (event_type <> 'error' OR value > 50)),
        decided AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY ts, event_id) = 1)
        SELECT h.o_orderkey AS draft_id, h.o_orderpriority AS store, coalesce(d.status, 'PENDING_APPROVAL') AS status, d.who AS decided_by FROM orders h LEFT JOIN decided d ON d.draft_id = h.o_orderkey""",
}
