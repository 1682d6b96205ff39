"""Queries over the stand-in tables and their SQL for a second engine.

Dates and times leave as text, which every engine and client shows alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.queries import cleaning, evaluation, files, questions, tools

MODULES = (cleaning, tools, evaluation, files, questions)
DATES = ("date", "txn_date", "loaded_at")


def _as_text(query):
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c in DATES if c in df.columns})

    return run


def _sql_as_text(name: str, text: str) -> str:
    shown = DATED.get(name)
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in shown)}) FROM (\n{text})" if shown else text


#: Queries whose results have such columns.
DATED = {
    **dict.fromkeys(["fact_sales_daily", "store_day_status", "sales_enriched", "zero_sale_days", "forecast_features", "weekday_baseline", "forecast_order_repair"], ("date",)),
    **dict.fromkeys(["inject_uom_alias", "inject_outage"], ("txn_date",)),
    "load_log": ("loaded_at",),
}
QUERIES = {name: _as_text(query) for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: _sql_as_text(name, text) for module in MODULES for name, text in module.ORACLES.items()}
