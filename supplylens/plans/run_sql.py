"""Ad-hoc SQL over the cleaned views: guard, limit, timeout, caveats and hints."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.operators.clean import Core
from supplylens.plans.guard import Rejected, check

MOST_ROWS, SECONDS, FEW_VALUES, MOST_HINTS = 200, 5.0, 20, 3
TABLES = ("sku_alias", "dim_sku", "load_batches", "fact_sales_daily", "store_day_status", "fact_price_weekly", "sales_enriched", "inventory")
RAW = {
    "pos_sales_lines": lambda raw: raw.sales_lines().drop("week"), "load_log": lambda raw: raw.load_log(), "erp_sku_master": lambda raw: raw.sku_master().drop("part_no"), "erp_suppliers": lambda raw: raw.suppliers(),
    "stores": lambda raw: raw.table("region").select(F.col("r_name").alias("store_code")), "calendar": lambda raw: raw.calendar(), "price_book": lambda raw: raw.price_book(), "inventory_snapshot": lambda raw: raw.inventory(),
}
SCHEMAS = ("core", "raw")
SALES = ("fact_sales_daily", "sales_enriched", "store_day_status")


@dataclass
class Result:
    """What a tool returns: data, what to mind, and where it came from."""

    data: Any
    caveats: list[str] = field(default_factory=list)
    provenance: dict[str, Any] = field(default_factory=dict)


def frames(core: Core, schema: str = "core") -> dict[str, DataFrame]:
    """The tables of a schema: cleaned ones, or the exports as they came, each stored when first asked for."""
    if schema == "core":
        return {name: getattr(core, name) for name in TABLES}
    return {name: _raw(core, name) for name in RAW}


def _raw(core: Core, name: str) -> DataFrame:
    return core.raw.store.table(f"raw_{name}", lambda: RAW[name](core.raw))


def describe(core: Core, schema: str = "core") -> DataFrame:
    """Every column of every table of a schema, with the table's number of rows."""
    spark, found = core.raw.spark, None
    for name, df in frames(core, schema).items():
        columns = [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
        rows = spark.createDataFrame(columns, "table_name string, position int, column_name string, type string")
        rows = rows.crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows"))))  # one row
        found = rows if found is None else found.unionByName(rows)
    return found


_published: dict[tuple[str, str], str] = {}
_lock = threading.Lock()


def _analysed(core: Core, text: str, schema: str, used: set[str]) -> DataFrame:
    """The query over external tables of the session's catalog that stand for the stored ones; they go with the session."""
    spark, root = core.raw.spark, core.raw.store.root
    built = {name: getattr(core, name) if schema == "core" else _raw(core, name) for name in used}  # before the time runs
    with _lock:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema} LOCATION '{root}/{schema}.db'")
        for name in used:
            path = core.raw.store.paths[name if schema == "core" else f"raw_{name}"]
            if _published.get((f"{spark.sparkContext.applicationId}.{schema}", name)) != path:
                spark.sql(f"DROP TABLE IF EXISTS {schema}.{name}")
                spark.catalog.createTable(f"{schema}.{name}", path=path, source="parquet", schema=built[name].schema)
                _published[f"{spark.sparkContext.applicationId}.{schema}", name] = path
        return spark.sql(text)


def filter_hints(df: DataFrame, column: str, value: str, few: int = FEW_VALUES) -> DataFrame:
    """Why a filter on a text column found nothing: values that differ in case, or else the few there are."""
    values = df.select(F.col(column).alias("value")).distinct()
    near = values.where((F.lower("value") == value.lower()) & (F.col("value") != value)).withColumn("hint", F.lit("differs in case"))
    if near.take(1) or values.where(F.col("value") == value).take(1):
        return near
    seen = values.limit(few + 1)
    count = seen.agg(F.count("*").alias("n"))
    return seen.crossJoin(F.broadcast(count)).where(F.col("n") <= few).select("value", F.lit("one of the values").alias("hint"))  # one row


class Timeout(RuntimeError):
    pass


def run_sql(core: Core, text: str, most: int = MOST_ROWS, seconds: float = SECONDS, schema: str = "core") -> Result:
    """At most `most` rows of a guarded query; its jobs are cancelled when time is up."""
    if schema not in SCHEMAS:
        raise ValueError(f"schema must be {' or '.join(SCHEMAS)}")
    spark = core.raw.spark
    used = check(spark, text, schema, set(TABLES if schema == "core" else RAW))
    most, found = max(1, min(int(most), MOST_ROWS)), _analysed(core, text, schema, used)
    began = time.time()  # a table's first use builds it
    tag, late, done = f"run-sql-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        # Again and again: jobs that start between planning steps are not yet there to be cancelled.
        if not done.wait(seconds):
            late.set()
            while not done.wait(0.2):
                context.cancelJobsWithTag(tag)

    context = spark.sparkContext
    context.addJobTag(tag)
    threading.Thread(target=stop, daemon=True).start()
    try:
        rows = found.limit(most + 1).collect()
    except Exception:
        if late.is_set():
            raise Timeout(f"the query took more than {seconds:g} s") from None
        raise
    finally:
        done.set()
        context.removeJobTag(tag)
    if late.is_set():
        raise Timeout(f"the query took more than {seconds:g} s")
    caveats = [f"Only the first {most} rows are shown."] if len(rows) > most else []
    if used & set(SALES):
        caveats.append("Store-days with status missing_data have no sales rows; a sum over them is a part, not a zero.")
    data = [r.asDict() for r in rows[:most]]
    if not data or len(data) == 1 and list(data[0].values()) in ([0], [None]):
        caveats += hints(core, found, schema)
    return Result(data, caveats, {"query": text, "schema": schema, "seconds": round(time.time() - began, 3)})


def _tree(nodes: list[dict]) -> dict:
    """An expression from its nodes in the order of a walk, each with its number of children."""
    walk = iter(nodes)

    def build() -> dict:
        node = dict(next(walk))
        node["below"] = [build() for _ in range(node["num-children"])]
        return node

    return build()


def _wanted(tree: dict) -> Iterator[tuple[int, list[str]]]:
    """(column's id, values) of comparisons of a column with constants by = or IN."""
    kind, below = tree["class"].rpartition(".")[2], tree["below"]
    name = lambda n: n["class"].rpartition(".")[2]
    if kind in ("EqualTo", "EqualNullSafe", "In") and below:
        columns, values = [n for n in below if name(n) == "AttributeReference"], [n for n in below if name(n) == "Literal"]
        if len(columns) == 1 and values and len(columns) + len(values) == len(below) and all(v["dataType"] == "string" for v in values):
            yield columns[0]["exprId"]["id"], [v["value"] for v in values if v["value"] is not None]
    if kind != "Not":  # what is excluded explains nothing
        for child in below:
            yield from _wanted(child)


def filters(df: DataFrame) -> list[tuple[str, str, str]]:
    """(table, column, value) of a query's filters by = or IN on text columns.

    The optimizer has put names, common table expressions and joins aside: filters stand over the tables' own
    columns there.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    owners, leaves = {}, plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.catalogTable().isDefined():
            table, output = leaf.catalogTable().get().identifier().table(), leaf.output()
            for k in range(output.size()):
                owners[output.apply(k).exprId().id()] = (table, output.apply(k).name())
    found: list[tuple[str, str, str]] = []
    for node in json.loads(plan.toJSON()):
        if node["class"].rpartition(".")[2] in ("Filter", "Join") and node.get("condition"):
            for column, values in _wanted(_tree(node["condition"])):
                if column in owners:
                    found += [(*owners[column], v) for v in values]
    return list(dict.fromkeys(found))


def hints(core: Core, df: DataFrame, schema: str = "core") -> list[str]:
    """Why filters on text columns may have found nothing: MOST_HINTS at most."""
    found: list[str] = []
    for table, column, value in filters(df):
        if len(found) < MOST_HINTS:
            own = getattr(core, table) if schema == "core" else _raw(core, table)
            rows = filter_hints(own, column, value).orderBy("value").collect()  # a few values
            if rows:
                found.append(f"{table}.{column}: {rows[0]['hint']}: {', '.join(r['value'] for r in rows)}")
    return found


__all__ = ["Rejected", "Result", "Timeout", "describe", "filter_hints", "filters", "frames", "hints", "run_sql"]
