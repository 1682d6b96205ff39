"""The faults put into the exports, written down by key, against what cleaning has found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded
from supplylens.operators.clean import Core, canonical, is_case
from supplylens.sources import files
from supplylens.sources.standin import OUTAGE_DAYS, OUTAGE_STORE, TWICE_STEP, Raw, inject_outage, inject_uom_alias

SCHEMA = "fault string, key string"


def _rows(fault: str, df: DataFrame, *columns: str | Column) -> DataFrame:
    key = F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns))
    return df.select(F.lit(fault).alias("fault"), key.alias("key")).distinct()


def injected(raw: Raw) -> DataFrame:
    """fault, key: what was changed, from the rules that changed it."""
    lines = inject_outage(inject_uom_alias(raw.lines()))
    old = lines.where(F.col("sku_code") != F.col("sku")).select("sku_code").union(raw.sku_master().join(raw.parts().select(F.col("sku").alias("sku_code")), "sku_code", "left_anti").select("sku_code"))
    true, book = raw.true_prices(), raw.price_book()
    kept = true.join(book.withColumnRenamed("price", "keyed"), ["store", "dept", "week"], "left")
    out = raw.table("region").where(F.col("r_name") == OUTAGE_STORE).select(F.col("r_name").alias("store"), F.explode(F.array(*(F.lit(d) for d in OUTAGE_DAYS))).alias("date"))
    sold_twice = raw.load_log().where(F.col("load_batch_id") >= TWICE_STEP)
    return reduce(
        DataFrame.unionByName,
        [
            _rows("alias_codes", old, "sku_code"), _rows("unit_of_measure", lines.where("uom <> 'EA'"), "store", "sku", "date"), _rows("duplicate_load", sold_twice, "source_file"), _rows("missing_days", out, "store", "date"),
            _rows("price_in_cents", kept.where("keyed > price"), "store", "dept", "week"), _rows("missing_price", kept.where("keyed IS NULL"), "store", "dept", "week"), _rows("missing_case_pack", raw.parts().where("part_no % 97 = 0"), "sku"),
        ],
    )


def flagged(core: Core) -> DataFrame:
    """fault, key: what cleaning says was wrong."""
    prices, lines = core.fact_price_weekly, core.raw.sales_lines()
    return reduce(
        DataFrame.unionByName,
        [
            _rows("alias_codes", core.sku_alias.where("is_alias"), "raw_code"), _rows("unit_of_measure", lines.where(is_case(F.col("uom"))), "store_code", canonical(F.col("sku_code")), "txn_date"), _rows("duplicate_load", core.load_batches.where("load_rank > 1"), "source_file"),
            _rows("missing_days", core.store_day_status.where("status = 'missing_data'"), "store", "date"), _rows("price_in_cents", prices.where("was_corrected"), "store", "dept", "week"), _rows("missing_price", prices.where("is_imputed"), "store", "dept", "week"),
            _rows("missing_case_pack", core.dim_sku.where("case_pack_imputed"), "sku"),
        ],
    )


def written(core: Core) -> DataFrame:
    """The manifest, read back from its file."""
    path = core.raw.store.file("manifest", lambda p: files.write_manifest(injected(core.raw), p))
    return files.read_manifest(core.raw.spark, path, SCHEMA)


def reconciled(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """By fault: how many there are, how many were found, recall and precision; one aggregation by key, no join."""
    both = manifest.withColumn("a", F.lit(1)).unionByName(found.withColumn("b", F.lit(1)), allowMissingColumns=True)
    x = both.groupBy("fault", "key").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    x = x.groupBy("fault").agg(F.count("a").alias("n_injected"), F.count("b").alias("n_flagged"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_right"))
    share = lambda c: rounded(F.col("n_right") / F.nullif(F.col(c).cast("double"), F.lit(0.0)), 6)
    return x.select("*", share("n_injected").alias("recall"), share("n_flagged").alias("precision"))
