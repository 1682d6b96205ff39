"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches to few rows, so that batches of very long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, one machine
    takes its own temporary folder; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        path = f"file://{tempfile.gettempdir()}/supplylens-checkpoints"
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, system = _file_system(spark, path)
    system.deleteOnExit(where)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them back.

    Later stages reread these files, so a lost executor costs no recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def forget(*frames: DataFrame) -> None:
    """Delete frames of durable() that no later frame reads."""
    for df in frames:
        where, system = _file_system(df.sparkSession, df.stored_at)
        system.delete(where, True)


def give_back() -> None:
    """In a Python worker: hand the memory that its earlier tasks have freed back to the system."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a name bound by a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text (null: none) as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add the 0-based place of each row among the rows of equal keys.

    Rows are dealt to salts by a hash of their order columns, numbered within (keys, salt) and
    moved by the sizes of the salts before; a key that holds most rows is numbered by many tasks.
    The frame is read twice, so it should be stored. Places follow the salts, then the order.
    """
    salts = max(16, shuffle_width(df.sparkSession))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    sizes = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_salt").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)) - 1
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = salted.withColumn("_at", at).join(sizes, [*same, F.col("_salt") == F.col("_of")])
    return joined.withColumn(name, F.col("_at") + F.col("_before")).drop("_salt", "_of", "_before", "_at", *(f"_{k}" for k in keys))


#: Numbers in the bitmap of wanted rows: a bound on what split_by_keys() broadcasts.
MARKS = 1 << 20


def split_by_keys(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose (id, text) is and isn't among the stored keys (id, th).

    Keys are first hashed to at most MARKS numbers, which are broadcast, so that only rows that may
    be among them are shuffled; the exact join follows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = docs.columns
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("th"))
    rows = rows.withColumn("mark", F.pmod(F.xxhash64("id", "th"), F.lit(MARKS)))
    keys = keys.select("id", "th").distinct()
    marks = F.broadcast(keys.select(F.pmod(F.xxhash64("id", "th"), F.lit(MARKS)).alias("mark")).distinct())
    maybe, never = rows.join(marks, "mark", "left_semi"), rows.join(marks, "mark", "left_anti")
    a, b = maybe.alias("a"), keys.alias("b")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th"))
    whole = [F.col("row").getField(c).alias(c) for c in columns]
    among, others = a.join(b, same, "left_semi"), a.join(b, same, "left_anti")
    return among.select("row").select(*whole), others.select("row").unionByName(never.select("row")).select(*whole)
