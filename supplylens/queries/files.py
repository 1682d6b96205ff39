"""Files of the outside world: tables are written as CSV or JSON lines once, then read by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.operators import manifest
from supplylens.operators.clean import core
from supplylens.queries.oracle import sql
from supplylens.sources import files
from supplylens.sources.standin import AS_OF, EPOCH, OUTAGE_DAYS, OUTAGE_STORE, TWICE_STEP, Raw, with_calendar
from supplylens.sources.store import store

DAYS, BOOK = "date date, week int, event_type string, snap boolean", "store string, dept string, week int, price double"
EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days on which the given tables have an order or a shipment, as a calendar file."""
    raw = Raw(spark, sf_dir)
    seen = raw.table("orders").select(F.col("o_orderdate").cast("date").alias("date")).union(raw.table("lineitem").select(F.col("l_shipdate").cast("date")))
    rows = with_calendar(seen.where("date IS NOT NULL").distinct()).repartition(1)  # a row for each day
    path = store(spark, sf_dir).file("calendar.csv", lambda p: files.write_csv(rows, p))
    return files.csv(spark, path, DAYS)


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store(spark, sf_dir).file("prices.csv", lambda p: files.write_csv(Raw(spark, sf_dir).price_book(), p))
    return files.csv(spark, path, BOOK)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Raw(spark, sf_dir).table("events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    path = store(spark, sf_dir).file("events.jsonl", lambda p: files.append_lines(rows, p))
    return files.read_lines(spark, path, EVENT)


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = files.calendar(_days(spark, sf_dir), "2000-01-01", AS_OF)
    return files.weekly_prices(_book(spark, sf_dir), "A%", weeks)


def _resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an event in the log: what is left to do by id."""
    todo = Raw(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("user_id"))
    return files.not_done(todo, _events(spark, sf_dir), "user_id")


QUERIES = {
    "csv_calendar": lambda s, d: files.calendar(_days(s, d), EPOCH, AS_OF),
    "csv_future_calendar": lambda s, d: files.future_calendar(_days(s, d), AS_OF),
    "csv_weekly_prices": _prices,
    "manifest_reconciliation": lambda s, d: manifest.reconciled(manifest.written(core(s, d)), manifest.flagged(core(s, d))),
    "jsonl_last_of_each": lambda s, d: files.last_of_each(_events(s, d), ["ts", "event_id"], "user_id").select("user_id", "event_id", "event_type", "value"),
    "jsonl_not_done": _resumed,
}

KEPT = "SELECT t.store, t.dept, t.week, t.price, b.price AS keyed FROM price_true t LEFT JOIN price_book b ON b.store = t.store AND b.dept = t.dept AND b.week = t.week"
INJECTED = f"""SELECT 'alias_codes' AS fault, sku_code AS key FROM (SELECT sku_code FROM remaining WHERE sku_code <> sku UNION SELECT sku_code FROM sku_master WHERE sku_code NOT IN (SELECT sku FROM parts))
    UNION SELECT 'unit_of_measure', concat_ws('|', store, sku, date) FROM remaining WHERE uom <> 'EA' UNION SELECT 'duplicate_load', source_file FROM load_log WHERE load_batch_id >= {TWICE_STEP}
    UNION SELECT 'missing_days', concat_ws('|', r_name, d) FROM region, (SELECT unnest(['{OUTAGE_DAYS[0]}', '{OUTAGE_DAYS[1]}']) AS d) WHERE r_name = '{OUTAGE_STORE}'
    UNION SELECT 'price_in_cents', concat_ws('|', store, dept, week) FROM ({KEPT}) WHERE keyed > price UNION SELECT 'missing_price', concat_ws('|', store, dept, week) FROM ({KEPT}) WHERE keyed IS NULL
    UNION SELECT 'missing_case_pack', sku FROM parts WHERE part_no % 97 = 0"""
FLAGGED = """SELECT 'alias_codes' AS fault, raw_code AS key FROM sku_alias WHERE is_alias UNION SELECT 'unit_of_measure', concat_ws('|', store_code, upper(trim(replace(sku_code, '-', '_'))), txn_date) FROM sales_lines WHERE upper(trim(uom)) IN ('CS', 'CASE')
    UNION SELECT 'duplicate_load', source_file FROM load_batches WHERE load_rank > 1 UNION SELECT 'missing_days', concat_ws('|', store, date) FROM day_status WHERE status = 'missing_data'
    UNION SELECT 'price_in_cents', concat_ws('|', store, dept, week) FROM price_clean WHERE was_corrected UNION SELECT 'missing_price', concat_ws('|', store, dept, week) FROM price_clean WHERE is_imputed UNION SELECT 'missing_case_pack', sku FROM dim_sku WHERE case_pack_imputed"""
ORACLES = {
    "manifest_reconciliation": sql(f"""SELECT *, floor(n_right / nullif(CAST(n_injected AS DOUBLE), 0) * 1000000 + 0.5) / 1000000 AS recall, floor(n_right / nullif(CAST(n_flagged AS DOUBLE), 0) * 1000000 + 0.5) / 1000000 AS precision
        FROM (SELECT coalesce(i.fault, f.fault) AS fault, count(i.key) AS n_injected, count(f.key) AS n_flagged, count(CASE WHEN i.key IS NOT NULL AND f.key IS NOT NULL THEN 1 END) AS n_right FROM ({INJECTED}) i FULL JOIN ({FLAGGED}) f ON f.fault = i.fault AND f.key = i.key GROUP BY 1)"""),
    "csv_calendar": sql(f"SELECT CAST(date AS VARCHAR) AS date, week, event_type, snap FROM seen_days WHERE date BETWEEN DATE '{EPOCH}' AND DATE '{AS_OF}'"),
    "csv_future_calendar": sql(f"SELECT CAST(date AS VARCHAR) AS date, week, event_type, snap FROM seen_days WHERE date > DATE '{AS_OF}' AND date <= DATE '{AS_OF}' + 28"),
    "csv_weekly_prices": sql(f"""SELECT store, dept, week, floor(price * 100 + 0.5) / 100 AS price FROM price_book
        WHERE store LIKE 'A%' AND week IN (SELECT week FROM seen_days WHERE date BETWEEN DATE '2000-01-01' AND DATE '{AS_OF}')"""),
    "jsonl_last_of_each": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1",
    "jsonl_not_done": "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
}
