"""CSV and JSON files of the outside world, read with a stated schema; nothing is inferred.

Date and state filters stand on the scan, so the CSV reader parses only the columns in use and drops
rows as it parses. Run results are JSON lines: appended as new files, resumed by id, the last one of
an id counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file or folder whose files have one header line each. Columns go by name against the header; a row
    that doesn't fit, or a file whose header differs from the others', fails the query."""
    header = spark.read.option("header", True).csv(path).columns
    types = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
    lacking = sorted(set(types) - set(header))
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    whole = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    return spark.read.schema(whole).options(header=True, mode="FAILFAST", enforceSchema=False).csv(path).select(*types)


def calendar(days: DataFrame, first: str, as_of: str) -> DataFrame:
    """The days from first to the as-of date, both included."""
    return days.where(F.col("date").between(F.lit(first).cast("date"), F.lit(as_of).cast("date")))


def future_calendar(days: DataFrame, as_of: str, horizon: int = 28) -> DataFrame:
    """The days after the as-of date that are published ahead."""
    start = F.lit(as_of).cast("date")
    return days.where((F.col("date") > start) & (F.col("date") <= F.date_add(start, horizon)))


def wide_units(spark: SparkSession, path: str, keys: list[str], days: list[str], where: Column | None = None) -> DataFrame:
    """Sales with a column for each day, as (keys, d, units) of the units above zero.

    `days` says which columns are read: the calendar bounds them. Rows are filtered before they are made long.
    """
    header = spark.read.option("header", True).csv(path).columns
    lacking = [c for c in days if c not in header]
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking[:5])}")
    wanted = set(days)
    schema = ", ".join(f"`{c}` {'int' if c in wanted else 'string'}" for c in header)
    wide = spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False).csv(path)
    if where is not None:
        wide = wide.where(where)
    names = F.split(F.lit("\n".join(days)), "\n")
    long = wide.select(*keys, F.posexplode(F.array(*days)).alias("_at", "units")).where(F.col("units") > 0)
    return long.select(*keys, F.get(names, F.col("_at")).alias("d"), "units")


def weekly_prices(book: DataFrame, pattern: str, weeks: DataFrame, store: str = "store", week: str = "week", price: str = "price") -> DataFrame:
    """Prices of the stores whose code is LIKE the pattern, in the weeks given, in whole cents."""
    kept = book.where(F.col(store).like(pattern)).join(weeks.select(week).distinct(), week, "left_semi")
    return kept.select(*(rounded(F.col(c)).alias(c) if c == price else c for c in book.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, emptyValue='""').csv(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The manifest as it was written; a line that doesn't fit fails the query."""
    return read_lines(spark, path, schema)


def write_manifest(df: DataFrame, path: str) -> None:
    """A manifest of injected faults, in place of an earlier one."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines; earlier files stay as they are."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def not_done(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What a run that is taken up again still has to do."""
    return todo.join(done.select(key), key, "left_anti")


def last_of_each(lines: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """The last line of each id by the columns of `order`."""
    w = Window.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in order))
    return lines.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")
