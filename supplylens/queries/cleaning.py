"""Cleaning layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.operators import relational
from supplylens.operators.clean import core
from supplylens.queries.oracle import sql
from supplylens.sources.standin import AS_OF, CASE_FROM, CASE_STORE, CASE_TO, EPOCH, Raw

QUERIES = {
    "sku_alias": lambda s, d: core(s, d).sku_alias,
    "dim_sku_imputed": lambda s, d: core(s, d).dim_sku,
    "load_log": lambda s, d: Raw(s, d).load_log(),
    "load_dedup": lambda s, d: core(s, d).load_batches.select("load_batch_id", "source_file", "row_count", "load_rank"),
    "fact_sales_daily": lambda s, d: core(s, d).fact_sales_daily,
    "store_day_status": lambda s, d: core(s, d).store_day_status,
    "price_weekly_clean": lambda s, d: core(s, d).fact_price_weekly,
    "sales_enriched": lambda s, d: core(s, d).sales_enriched,
    "inventory_clean": lambda s, d: core(s, d).inventory,
    "inventory_reconcile": lambda s, d: relational.reconcile(core(s, d).inventory, Raw(s, d).true_inventory(), ["store", "sku"], ["on_hand", "on_order"]),
    "dq_issues": lambda s, d: core(s, d).issues(),
    "store_day_caveats": lambda s, d: core(s, d).caveats("1999-01-01", "2000-12-31"),
    "exact_recovery_diff": lambda s, d: relational.recovery(core(s, d), Raw(s, d)),
    "latest_price": lambda s, d: relational.latest(core(s, d).fact_price_weekly, ["store", "dept"], "week", ["price"]),
    "inject_uom_alias": lambda s, d: Raw(s, d).sales_lines().where((F.col("uom") != "EA") | (F.col("sku_code") != F.upper(F.trim(F.replace("sku_code", F.lit("-"), F.lit("_")))))).select("txn_date", "store_code", "sku_code", "qty", "uom"),
    "inject_outage": lambda s, d: Raw(s, d).sales_lines().groupBy("txn_date", "store_code").agg(F.count("*").alias("n_lines")),
    "uom_pool_having": lambda s, d: relational.busy(Raw(s, d).lines(), CASE_STORE, CASE_FROM, CASE_TO, 2),
    "unpivot_wide": lambda s, d: relational.long_form(Raw(s, d).wide_units(), ["dept"], "d", "units"),
}

ORACLES = {
    "sku_alias": sql("SELECT raw_code, sku, is_alias FROM sku_alias"),
    "dim_sku_imputed": sql("SELECT * FROM dim_sku"),
    "load_log": sql("SELECT * FROM load_log"),
    "load_dedup": sql("SELECT load_batch_id, source_file, row_count, load_rank FROM load_batches"),
    "fact_sales_daily": sql("SELECT date, store, sku, units, n_lines FROM fact"),
    "store_day_status": sql("SELECT * FROM day_status"),
    "price_weekly_clean": sql("SELECT * FROM price_clean"),
    "sales_enriched": sql("SELECT * FROM enriched"),
    "inventory_clean": sql("SELECT * FROM inventory"),
    "inventory_reconcile": sql("""SELECT coalesce(i.store, t.store) AS store, coalesce(i.sku, t.sku) AS sku, i.on_hand AS on_hand_got, t.on_hand AS on_hand_true, i.on_order AS on_order_got, t.on_order AS on_order_true,
        i.on_hand IS DISTINCT FROM t.on_hand OR i.on_order IS DISTINCT FROM t.on_order AS differs FROM inventory i FULL JOIN stock t ON i.store = t.store AND i.sku = t.sku"""),
    "dq_issues": sql("""SELECT 'alias_codes' AS issue_type, 'pos_sales_lines' AS source_table, count(*) AS rows_affected, count(DISTINCT sku_code) || ' old codes on sales lines' AS finding, 'mapped to the canonical SKU' AS fix_applied
          FROM sales_lines WHERE sku_code <> upper(trim(replace(sku_code, '-', '_')))
        UNION ALL SELECT 'unit_of_measure', 'pos_sales_lines', count(*), 'lines in cases at ' || coalesce(string_agg(DISTINCT store_code, ', ' ORDER BY store_code), ''), 'multiplied by the case pack' FROM sales_lines WHERE upper(trim(uom)) IN ('CS', 'CASE')
        UNION ALL SELECT 'duplicate_load', 'load_log', CAST(coalesce(sum(row_count), 0) AS BIGINT), 'loaded twice: ' || coalesce(string_agg(DISTINCT source_file, ', ' ORDER BY source_file), ''), 'kept the first load' FROM load_batches WHERE load_rank > 1
        UNION ALL SELECT 'missing_days', 'pos_sales_lines', count(*), count(*) || ' store-days without data', 'flagged missing_data' FROM day_status WHERE status = 'missing_data'
        UNION ALL SELECT 'closed_days', 'pos_sales_lines', count(*), count(*) || ' store-days closed', 'flagged closed_all_stores' FROM day_status WHERE status = 'closed_all_stores'
        UNION ALL SELECT 'price_in_cents', 'price_book', count(*), count(*) || ' prices keyed in cents', 'divided by 100' FROM price_clean WHERE was_corrected
        UNION ALL SELECT 'missing_price', 'price_book', count(*), count(*) || ' weeks without a price', 'carried the last price' FROM price_clean WHERE is_imputed
        UNION ALL SELECT 'missing_case_pack', 'erp_sku_master', count(*), count(*) || ' case packs not set', 'took the department''s mode' FROM dim_sku WHERE case_pack_imputed"""),
    "store_day_caveats": sql("""SELECT status, count(*) AS n_days, string_agg(CAST(date AS VARCHAR) || ' (' || stores || ')', '; ' ORDER BY CAST(date AS VARCHAR) || ' (' || stores || ')') AS days
        FROM (SELECT status, date, string_agg(store, ', ' ORDER BY store) AS stores FROM day_status WHERE status <> 'open' AND date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY 1, 2) GROUP BY status"""),
    "exact_recovery_diff": sql(f"""SELECT CASE WHEN date = DATE '1999-12-25' THEN 'closure' WHEN store = 'AFRICA' AND date IN (DATE '2000-05-10', DATE '2000-05-11') THEN 'outage' ELSE 'other' END AS reason, count(*) AS rows
        FROM ((SELECT date, store, sku, CAST(sum(units) AS BIGINT) AS units FROM lines GROUP BY 1, 2, 3 EXCEPT ALL SELECT date, store, sku, units FROM fact)
          UNION ALL (SELECT date, store, sku, units FROM fact EXCEPT ALL SELECT date, store, sku, CAST(sum(units) AS BIGINT) FROM lines GROUP BY 1, 2, 3)) WHERE date <= DATE '{AS_OF}' GROUP BY 1"""),
    "latest_price": sql("SELECT store, dept, week, price FROM price_clean QUALIFY row_number() OVER (PARTITION BY store, dept ORDER BY week DESC) = 1"),
    "inject_uom_alias": sql("SELECT txn_date, store_code, sku_code, qty, uom FROM sales_lines WHERE uom <> 'EA' OR sku_code <> upper(trim(replace(sku_code, '-', '_')))"),
    "inject_outage": sql("SELECT txn_date, store_code, count(*) AS n_lines FROM sales_lines GROUP BY 1, 2"),
    "uom_pool_having": sql(f"SELECT sku, count(*) AS n_lines, CAST(sum(units) AS BIGINT) AS units FROM lines WHERE store = '{CASE_STORE}' AND date BETWEEN DATE '{CASE_FROM}' AND DATE '{CASE_TO}' GROUP BY sku HAVING count(*) >= 2"),
    "unpivot_wide": sql(f"""SELECT p.dept, 'd_' || k AS d, CAST(coalesce(u.units, 0) AS BIGINT) AS units FROM (SELECT DISTINCT dept FROM lines) p CROSS JOIN range(1, DATE '{AS_OF}' - DATE '{EPOCH}' + 2) r(k)
        LEFT JOIN (SELECT dept, date - DATE '{EPOCH}' + 1 AS k, sum(units) AS units FROM lines GROUP BY 1, 2) u USING (dept, k)"""),
}
