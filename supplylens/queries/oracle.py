"""SQL of the second engine: named steps, of which a query takes those it needs."""

from __future__ import annotations

import re
from statistics import NormalDist

from supplylens.sources import standin as s

STEPS = {
    "places": "SELECT s_suppkey, r_name AS store, r_regionkey AS store_no FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "parts": "SELECT p_partkey AS part_no, upper(p_type) || '_' || p_partkey AS sku, p_name AS description, p_type AS dept, p_brand AS category, p_size AS pack, p_retailprice AS shelf FROM part",
    "lines": f"""SELECT l_orderkey, CAST(l_shipdate AS DATE) AS date, l_quantity AS units, l_extendedprice AS amount, store, store_no, parts.*,
        CAST((CAST(l_shipdate AS DATE) - DATE '{s.EPOCH}') // 7 AS INTEGER) AS week
        FROM lineitem JOIN places ON l_suppkey = s_suppkey JOIN parts ON l_partkey = part_no WHERE CAST(l_shipdate AS DATE) <= DATE '{s.AS_OF}'""",
    "faulty": f"""SELECT *, CASE WHEN date >= DATE '{s.ALIAS_FROM}' AND part_no % 40 = 0 THEN replace(sku, '_', '-')
          WHEN date >= DATE '{s.ALIAS_FROM}' AND part_no % 40 = 1 THEN lower(sku)
          WHEN date >= DATE '{s.ALIAS_FROM}' AND part_no % 40 = 2 THEN sku || ' ' ELSE sku END AS sku_code,
        (store = '{s.CASE_STORE}' AND part_no % 50 = 3 AND part_no % 97 <> 0 AND date BETWEEN DATE '{s.CASE_FROM}' AND DATE '{s.CASE_TO}') AS cases FROM lines""",
    "injected": """SELECT date, store, store_no, sku, sku_code, week, CASE WHEN cases THEN floor(units / pack * 1000 + 0.5) / 1000 ELSE units END AS qty,
        CASE WHEN NOT cases THEN 'EA' WHEN l_orderkey % 3 = 0 THEN 'CS' WHEN l_orderkey % 3 = 1 THEN 'cs' ELSE 'Case' END AS uom FROM faulty""",
    "remaining": f"SELECT * FROM injected WHERE NOT (store = '{s.OUTAGE_STORE}' AND date IN (DATE '{s.OUTAGE_DAYS[0]}', DATE '{s.OUTAGE_DAYS[1]}')) AND date <> DATE '{s.CLOSURE}'",
    "once": "SELECT date AS txn_date, store AS store_code, sku_code, qty, uom, CAST(week AS BIGINT) * 10 + store_no AS load_batch_id, week FROM remaining",
    "sales_lines": f"SELECT * FROM once UNION ALL SELECT txn_date, store_code, sku_code, qty, uom, load_batch_id + {s.TWICE_STEP}, week FROM once WHERE store_code = '{s.TWICE_STORE}' AND week = {s.TWICE_WEEK}",
    "load_log": f"""SELECT load_batch_id, store_code || '_w' || week AS source_file,
        CAST(DATE '{s.EPOCH}' + (week + 1) * 7 AS TIMESTAMP) + CASE WHEN load_batch_id >= {s.TWICE_STEP} THEN INTERVAL 79 HOUR ELSE INTERVAL 0 HOUR END AS loaded_at, count(*) AS row_count
        FROM sales_lines GROUP BY load_batch_id, store_code, week""",
    "master_once": """SELECT sku AS sku_code, description, dept, category, 'EA' AS base_uom,
        CASE WHEN part_no % 97 = 0 AND part_no % 2 = 0 THEN NULL WHEN part_no % 97 = 0 THEN 0 ELSE pack END AS case_pack,
        floor(shelf * 0.6 * 100 + 0.5) / 100 AS unit_cost, part_no % (SELECT count(*) FROM supplier) AS supplier_id, part_no FROM parts""",
    "sku_master": "SELECT * FROM master_once UNION ALL SELECT replace(sku_code, '_', '-'), description, dept, category, base_uom, case_pack, unit_cost, supplier_id, part_no FROM master_once WHERE part_no % 40 = 0",
    "suppliers": "SELECT s_suppkey AS supplier_id, s_name AS supplier_name, CAST(3 + s_suppkey % 12 AS INTEGER) AS lead_time_days, CAST(1 + s_suppkey % 10 AS INTEGER) AS min_order_cases FROM supplier",
    "price_true": "SELECT store, dept, week, floor(median(amount / units) * 100 + 0.5) / 100 AS price FROM lines GROUP BY store, dept, week",
    "price_book": """SELECT store, dept, week, CASE WHEN (length(dept) + week) % 97 = 0 THEN price * 100 ELSE price END AS price
        FROM (SELECT *, min(week) OVER (PARTITION BY store, dept) AS first_week FROM price_true) WHERE week = first_week OR (length(dept) + week) % 61 <> 7""",
    "stock": """SELECT r_name AS store, sku, part_no, CAST(CASE WHEN part_no % 25 = 0 THEN 0 ELSE (part_no * 7 + r_regionkey * 13) % 60 END AS BIGINT) AS on_hand, CAST((part_no % 4) * pack AS BIGINT) AS on_order FROM parts, region""",
    "inventory_raw": """SELECT store, sku AS sku_code, CASE WHEN part_no % 40 = 0 THEN on_hand // 2 ELSE on_hand END AS on_hand, on_order FROM stock
        UNION ALL SELECT store, replace(sku, '_', '-'), on_hand - on_hand // 2, 0 FROM stock WHERE part_no % 40 = 0""",
    "calendar": f"""SELECT date, CAST((date - DATE '{s.EPOCH}') // 7 AS INTEGER) AS week, CASE WHEN month(date) = 12 AND day(date) = 25 THEN 'National' WHEN month(date) = 5 AND day(date) = 1 THEN 'Cultural' END AS event_type, day(date) <= 10 AS snap
        FROM (SELECT CAST(unnest(generate_series(DATE '{s.EPOCH}', DATE '{s.AS_OF}' + 28, INTERVAL 1 DAY)) AS DATE) AS date)""",
    "seen_days": f"""SELECT date, CAST((date - DATE '{s.EPOCH}') // 7 AS INTEGER) AS week, CASE WHEN month(date) = 12 AND day(date) = 25 THEN 'National' WHEN month(date) = 5 AND day(date) = 1 THEN 'Cultural' END AS event_type, day(date) <= 10 AS snap
        FROM (SELECT CAST(o_orderdate AS DATE) AS date FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem) WHERE date IS NOT NULL""",
    # Cleaned tables.
    "codes": "SELECT sku_code FROM sku_master UNION SELECT sku_code FROM sales_lines UNION SELECT sku_code FROM inventory_raw",
    "sku_alias": "SELECT sku_code AS raw_code, upper(trim(replace(sku_code, '-', '_'))) AS sku, sku_code <> upper(trim(replace(sku_code, '-', '_'))) AS is_alias FROM codes",
    "own": "SELECT m.* FROM sku_master m JOIN sku_alias a ON a.raw_code = m.sku_code AND NOT a.is_alias",
    "packs": "SELECT dept, case_pack AS usual FROM (SELECT dept, case_pack, row_number() OVER (PARTITION BY dept ORDER BY count(*) DESC, case_pack) AS k FROM own WHERE case_pack > 0 GROUP BY dept, case_pack) WHERE k = 1",
    "last_sale": "SELECT sku, max(date) AS last_date FROM lines GROUP BY sku",
    "dim_sku": f"""SELECT o.sku_code AS sku, o.description, o.dept, o.category, CAST(CASE WHEN o.case_pack > 0 THEN o.case_pack ELSE p.usual END AS INTEGER) AS case_pack,
        NOT coalesce(o.case_pack > 0, false) AS case_pack_imputed, o.unit_cost, o.supplier_id,
        CASE WHEN l.last_date IS NULL OR l.last_date < DATE '{s.AS_OF}' - 365 THEN 'DISCONTINUED' ELSE 'ACTIVE' END AS status
        FROM own o JOIN packs p USING (dept) LEFT JOIN last_sale l ON l.sku = o.sku_code""",
    "load_batches": "SELECT *, CAST(row_number() OVER (PARTITION BY source_file ORDER BY loaded_at, load_batch_id) AS BIGINT) AS load_rank FROM load_log",
    "fact": """SELECT txn_date AS date, store_code AS store, a.sku, CAST(sum(floor(CASE WHEN upper(trim(uom)) IN ('CS', 'CASE') THEN qty * k.case_pack ELSE qty END + 0.5)) AS BIGINT) AS units, count(*) AS n_lines
        FROM sales_lines x JOIN load_batches b ON b.load_batch_id = x.load_batch_id AND b.load_rank = 1 JOIN sku_alias a ON a.raw_code = x.sku_code JOIN dim_sku k ON k.sku = a.sku GROUP BY 1, 2, 3""",
    "day_grid": f"SELECT c.date, r_name AS store FROM calendar c, region WHERE c.date <= DATE '{s.AS_OF}'",
    "day_counts": "SELECT g.date, g.store, coalesce(f.n, 0) AS n_lines, coalesce(f.u, 0) AS units FROM day_grid g LEFT JOIN (SELECT date, store, CAST(sum(n_lines) AS BIGINT) AS n, CAST(sum(units) AS BIGINT) AS u FROM fact GROUP BY 1, 2) f USING (date, store)",
    "day_flags": "SELECT d.*, d.n_lines < 0.05 * m.mid AS thin FROM day_counts d JOIN (SELECT store, median(n_lines) AS mid FROM day_counts GROUP BY store) m USING (store)",
    "day_status": """SELECT date, store, CAST(n_lines AS BIGINT) AS n_lines, CAST(units AS BIGINT) AS units, CASE WHEN NOT thin THEN 'open' WHEN bool_and(thin) OVER (PARTITION BY date) THEN 'closed_all_stores' ELSE 'missing_data' END AS status FROM day_flags""",
    "price_fixed": "SELECT b.store, b.dept, b.week, CASE WHEN b.price > 20 * m.mid THEN floor(b.price / 100 * 100 + 0.5) / 100 ELSE b.price END AS price, b.price > 20 * m.mid AS was_corrected FROM price_book b JOIN (SELECT store, dept, median(price) AS mid FROM price_book GROUP BY 1, 2) m USING (store, dept)",
    "price_span": "SELECT store, dept, min(w) AS w0, max(w) AS w1 FROM (SELECT store, dept, week AS w FROM price_fixed UNION ALL SELECT store, dept, week FROM lines) GROUP BY 1, 2",
    "price_weeks": "SELECT store, dept, CAST(unnest(range(w0, w1 + 1)) AS INTEGER) AS week FROM price_span",
    "price_clean": """SELECT store, dept, week, last_value(price IGNORE NULLS) OVER w AS price, price IS NULL AS is_imputed, coalesce(was_corrected, false) AS was_corrected
        FROM price_weeks LEFT JOIN price_fixed USING (store, dept, week) WINDOW w AS (PARTITION BY store, dept ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "enriched": f"""SELECT f.date, CAST((f.date - DATE '{s.EPOCH}') // 7 AS INTEGER) AS week, f.store, f.sku, k.dept, k.category, f.units, p.price, floor(f.units * p.price * 100 + 0.5) / 100 AS revenue, p.is_imputed AS price_is_imputed
        FROM fact f JOIN dim_sku k USING (sku) LEFT JOIN price_clean p ON p.store = f.store AND p.dept = k.dept AND p.week = CAST((f.date - DATE '{s.EPOCH}') // 7 AS INTEGER)""",
    "inventory": "SELECT i.store, a.sku, CAST(sum(on_hand) AS BIGINT) AS on_hand, CAST(sum(on_order) AS BIGINT) AS on_order FROM inventory_raw i JOIN sku_alias a ON a.raw_code = i.sku_code JOIN dim_sku k ON k.sku = a.sku GROUP BY 1, 2",
    # Tools.
    "price_last": "SELECT store, dept, price FROM price_clean QUALIFY row_number() OVER (PARTITION BY store, dept ORDER BY week DESC) = 1",
    "week_sums": f"""SELECT store, dept, CAST((DATE '{s.AS_OF}' - date) // 7 AS INTEGER) AS block, CAST(sum(units) AS DOUBLE) AS u FROM enriched WHERE date > DATE '{s.AS_OF}' - 63 GROUP BY 1, 2, 3""",
    "week_lost": f"SELECT DISTINCT store, CAST((DATE '{s.AS_OF}' - date) // 7 AS INTEGER) AS block FROM day_status WHERE status = 'missing_data' AND date > DATE '{s.AS_OF}' - 63",
    "week_base": "SELECT store, dept, CAST(sum(u) FILTER (WHERE block = 0) AS BIGINT) AS this_week, avg(u) FILTER (WHERE block > 0) AS m, stddev_samp(u) FILTER (WHERE block > 0) AS sd, count(u) FILTER (WHERE block > 0) AS n FROM week_sums ANTI JOIN week_lost USING (store, block) GROUP BY 1, 2",
    "week_found": """SELECT store, dept AS subject, 'dept' AS level, CASE WHEN this_week > m THEN 'sales_spike' ELSE 'sales_drop' END AS anomaly, this_week, floor(m * 10000 + 0.5) / 10000 AS base_mean,
        floor((this_week - m) / nullif(m, 0) * 10000 + 0.5) / 10000 AS pct_change, floor((this_week - m) / nullif(sd, 0) * 10000 + 0.5) / 10000 AS z
        FROM week_base WHERE n >= 3 AND abs((this_week - m) / nullif(m, 0)) > 0.25 AND abs((this_week - m) / nullif(sd, 0)) > 2""",
    # Variance of 2000 against 1999.
    "shelf_mean": """SELECT p.store, p.dept, avg(price) FILTER (WHERE year(date) = 1999) AS shelf_a, avg(price) FILTER (WHERE year(date) = 2000) AS shelf_b FROM calendar c JOIN price_clean p ON p.week = c.week GROUP BY 1, 2""",
    "sku_periods": """SELECT store, sku, dept, category, coalesce(sum(units) FILTER (WHERE year(date) = 1999), 0) AS q_a, coalesce(sum(revenue) FILTER (WHERE year(date) = 1999), 0.0) AS r_a,
        coalesce(sum(units) FILTER (WHERE year(date) = 2000), 0) AS q_b, coalesce(sum(revenue) FILTER (WHERE year(date) = 2000), 0.0) AS r_b FROM enriched WHERE year(date) IN (1999, 2000) GROUP BY 1, 2, 3, 4""",
    "sku_prices": "SELECT x.*, coalesce(r_a / nullif(CAST(q_a AS DOUBLE), 0), shelf_a, r_b / nullif(CAST(q_b AS DOUBLE), 0), shelf_b, 0.0) AS p_a FROM sku_periods x LEFT JOIN shelf_mean h ON h.store = x.store AND h.dept = x.dept",
    # Forecasts from 2001-06-02.
    "series_days": "SELECT f.date, f.store, k.dept, CAST(sum(f.units) AS BIGINT) AS u FROM fact f JOIN dim_sku k USING (sku) GROUP BY 1, 2, 3",
    "series_first": "SELECT store, dept, min(date) AS first_sale FROM series_days GROUP BY 1, 2",
    "dense": f"""SELECT x.store, x.dept, c.date, x.first_sale, c.week, c.event_type, c.snap, CASE WHEN d.status IS NULL OR d.status = 'missing_data' THEN NULL ELSE coalesce(y.u, 0) END AS units
        FROM series_first x JOIN calendar c ON c.date >= x.first_sale AND c.date <= DATE '{s.AS_OF}' AND c.date >= DATE '2000-12-01' LEFT JOIN series_days y ON y.store = x.store AND y.dept = x.dept AND y.date = c.date LEFT JOIN day_status d ON d.store = x.store AND d.date = c.date""",
    "weekday_mean": "SELECT store, dept, isodow(date) AS wd, avg(units) AS m FROM dense WHERE date > DATE '2001-06-02' - 28 AND date <= DATE '2001-06-02' GROUP BY 1, 2, 3",
    "ahead": "SELECT DATE '2001-06-02' + CAST(i AS INTEGER) AS date FROM range(1, 29) r(i)",
    "baseline": "SELECT x.store, x.dept, a.date, floor(coalesce(m.m, 0.0) * 1000000 + 0.5) / 1000000 AS mean FROM (SELECT DISTINCT store, dept FROM weekday_mean) x CROSS JOIN ahead a LEFT JOIN weekday_mean m ON m.store = x.store AND m.dept = x.dept AND m.wd = isodow(a.date)",
    "spreads": "SELECT store, dept, coalesce(quantile_cont(units, 0.1), 0) AS q10, coalesce(quantile_cont(units, 0.9), 0) AS q90, avg(units) AS v FROM dense WHERE date > DATE '2001-06-02' - 56 AND date <= DATE '2001-06-02' GROUP BY 1, 2",
    "predicted": """SELECT b.store, b.dept, b.date, floor(least(greatest(coalesce(q10, 0), 0.0), greatest(mean, 0.0)) * 1000000 + 0.5) / 1000000 AS p10, greatest(mean, 0.0) AS mean,
        floor(greatest(coalesce(q90, 0), 0.0, mean) * 1000000 + 0.5) / 1000000 AS p90 FROM baseline b LEFT JOIN spreads s ON s.store = b.store AND s.dept = b.dept""",
    "speed_bands": "SELECT store, dept, floor(v * 1000000 + 0.5) / 1000000 AS per_day, CASE WHEN v <= 1 THEN 'slow' WHEN v <= 5 THEN 'medium' ELSE 'fast' END AS band FROM spreads",
    "scored": "SELECT p.*, d.units AS actual, v.band FROM predicted p JOIN dense d ON d.store = p.store AND d.dept = p.dept AND d.date = p.date AND d.units IS NOT NULL JOIN speed_bands v ON v.store = p.store AND v.dept = p.dept",
    # Errors by store and SKU: a flat mean of 28 days against the same weekday's.
    "sku_flat": "SELECT store, sku, coalesce(avg(units), 0.0) AS flat FROM sku_days WHERE date > DATE '2001-06-02' - 28 GROUP BY 1, 2",
    "unit_errors": """SELECT m.store, m.sku, CAST(any_value(g.r_regionkey) AS BIGINT) * 1000000007 + CAST(regexp_extract(m.sku, '[0-9]+$') AS BIGINT) AS key, sum(abs(coalesce(y.units, 0) - f.flat)) AS old, sum(abs(coalesce(y.units, 0) - m.mean)) AS new, CAST(sum(coalesce(y.units, 0)) AS DOUBLE) AS total
        FROM sku_mean m JOIN sku_flat f ON f.store = m.store AND f.sku = m.sku JOIN day_status d ON d.store = m.store AND d.date = m.date AND d.status <> 'missing_data'
        JOIN region g ON g.r_name = m.store LEFT JOIN fact y ON y.store = m.store AND y.sku = m.sku AND y.date = m.date GROUP BY 1, 2""",
    # The same by SKU, and what to order.
    "sku_first": "SELECT store, sku, min(date) AS first_sale FROM fact GROUP BY 1, 2",
    "sku_days": """SELECT x.store, x.sku, c.date, CASE WHEN d.status IS NULL OR d.status = 'missing_data' THEN NULL ELSE coalesce(y.units, 0) END AS units
        FROM sku_first x JOIN calendar c ON c.date >= x.first_sale AND c.date > DATE '2001-06-02' - 56 AND c.date <= DATE '2001-06-02'
        LEFT JOIN fact y ON y.store = x.store AND y.sku = x.sku AND y.date = c.date LEFT JOIN day_status d ON d.store = x.store AND d.date = c.date""",
    "sku_weekday": "SELECT store, sku, isodow(date) AS wd, avg(units) AS m FROM sku_days WHERE date > DATE '2001-06-02' - 28 GROUP BY 1, 2, 3",
    "sku_spread": "SELECT store, sku, coalesce(quantile_cont(units, 0.9), 0) AS q90 FROM sku_days GROUP BY 1, 2",
    "sku_mean": "SELECT x.store, x.sku, a.date, floor(coalesce(m.m, 0.0) * 1000000 + 0.5) / 1000000 AS mean FROM (SELECT DISTINCT store, sku FROM sku_weekday) x CROSS JOIN ahead a LEFT JOIN sku_weekday m ON m.store = x.store AND m.sku = x.sku AND m.wd = isodow(a.date)",
    "sku_ahead": "SELECT b.store, b.sku, b.date, greatest(mean, 0.0) AS mean, floor(greatest(coalesce(q90, 0), 0.0, mean) * 1000000 + 0.5) / 1000000 AS p90 FROM sku_mean b LEFT JOIN sku_spread s ON s.store = b.store AND s.sku = b.sku",
    "sku_stock": "SELECT v.store, v.sku, v.on_hand, v.on_order, k.dept, k.case_pack, k.unit_cost, k.supplier_id, p.lead_time_days, p.min_order_cases FROM inventory v JOIN dim_sku k ON k.sku = v.sku AND k.status = 'ACTIVE' JOIN suppliers p ON p.supplier_id = k.supplier_id",
    "sku_need": f"""SELECT f.store, f.sku, sum(mean) AS d, {NormalDist().inv_cdf(0.95)!r} * sqrt(sum(pow(greatest(p90 - mean, 0) / 1.2816, 2))) AS sf
        FROM sku_ahead f JOIN sku_stock i ON i.store = f.store AND i.sku = f.sku AND f.date <= DATE '2001-06-02' + i.lead_time_days + 7 GROUP BY 1, 2""",
    "order_lines": "SELECT i.*, f.d, f.sf, CAST(ceil(greatest(f.d + f.sf - i.on_hand - i.on_order, 0) / CAST(case_pack AS DOUBLE) - 1e-9) AS BIGINT) AS cases FROM sku_stock i JOIN sku_need f ON f.store = i.store AND f.sku = i.sku",
}


def stock_steps(prefix: str, days: int) -> dict[str, str]:
    """Stock anomalies by the sales of so many days."""
    last = f"date > DATE '{s.AS_OF}' - {days} AND date <= DATE '{s.AS_OF}'"
    return {
        f"{prefix}_open": f"SELECT store, count(*) AS open_days FROM day_status WHERE status = 'open' AND {last} GROUP BY store",
        f"{prefix}_units": f"SELECT store, sku, CAST(sum(units) AS DOUBLE) AS u FROM fact WHERE {last} GROUP BY 1, 2",
        f"{prefix}_rates": f"""SELECT i.*, k.dept, k.unit_cost, p.lead_time_days, coalesce(u.u, 0.0) / nullif(CAST(o.open_days AS DOUBLE), 0) AS a, l.price
        FROM inventory i JOIN dim_sku k ON k.sku = i.sku AND k.status = 'ACTIVE' JOIN suppliers p ON p.supplier_id = k.supplier_id
        LEFT JOIN {prefix}_units u ON u.store = i.store AND u.sku = i.sku LEFT JOIN {prefix}_open o ON o.store = i.store LEFT JOIN price_last l ON l.store = i.store AND l.dept = k.dept""",
        f"{prefix}_kinds": f"""SELECT *, CASE WHEN on_hand = 0 AND a > 0 THEN 'stockout' WHEN (on_hand + on_order) / nullif(a, 0) < lead_time_days THEN 'stockout_risk'
        WHEN on_hand / nullif(a, 0) > 90 THEN 'overstock' WHEN a = 0 AND on_hand >= 24 THEN 'dead_stock' END AS anomaly FROM {prefix}_rates""",
        f"{prefix}_found": f"""SELECT store, sku, dept, anomaly, on_hand, on_order, floor(a * 10000 + 0.5) / 10000 AS avg_daily, floor(on_hand / nullif(a, 0) * 10000 + 0.5) / 10000 AS days_of_cover, lead_time_days,
        floor(CASE anomaly WHEN 'stockout' THEN a * lead_time_days * price WHEN 'stockout_risk' THEN (a * lead_time_days - on_hand - on_order) * price WHEN 'overstock' THEN (on_hand - 30 * a) * unit_cost ELSE on_hand * unit_cost END * 100 + 0.5) / 100 AS value
        FROM {prefix}_kinds WHERE anomaly IS NOT NULL""",
    }


def sku_steps(prefix: str, scale: int, stopped: float) -> dict[str, str]:
    """SKUs that stopped or spiked, by windows of 7, 14 and 42 days times the scale."""
    ago, week = lambda n: f"DATE '{s.AS_OF}' - {n * scale}", 7.0 * scale
    return {
        f"{prefix}_base": f"""SELECT store, sku, coalesce(sum(units) FILTER (WHERE date > {ago(14)}), 0) AS l14, CAST(sum(units) FILTER (WHERE date <= {ago(14)}) AS DOUBLE) / {28.0 * scale} AS b,
        CAST(coalesce(sum(units) FILTER (WHERE date > {ago(7)}), 0) AS BIGINT) AS l7 FROM fact WHERE date > {ago(42)} AND date <= DATE '{s.AS_OF}' GROUP BY 1, 2""",
        f"{prefix}_found": f"""SELECT store, sku AS subject, 'sku' AS level, CASE WHEN l14 = 0 THEN 'sales_stopped' ELSE 'sku_spike' END AS anomaly, l7 AS this_week, floor(b * {week} * 10000 + 0.5) / 10000 AS base_mean,
        floor((l7 - b * {week}) / (b * {week}) * 10000 + 0.5) / 10000 AS pct_change, CAST(NULL AS DOUBLE) AS z FROM {prefix}_base WHERE (l14 = 0 AND b >= {stopped}) OR (l7 >= 20 AND l7 > 4 * b * {week})""",
    }


# A month is the rule; a year and windows of eight times the length also find something in sparse sales.
STEPS |= stock_steps("stock", 365) | stock_steps("month_stock", 28) | sku_steps("sku", 8, 0.05) | sku_steps("week_sku", 1, 1.5)


def sql(final: str) -> str:
    """The query with the steps it refers to, and those they refer to, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z_]+\b", text):
            if name in STEPS and name not in needed:
                visit(STEPS[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    steps = ",\n".join(f"{n} AS ({STEPS[n]})" for n in needed)
    return f"WITH {steps}\n{final}" if needed else final
