"""Built tables: each layer is written once as Parquet and read by whatever comes after it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one machine takes its own temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        path = f"file://{tempfile.gettempdir()}/supplylens-tables"
    return path.rstrip("/")


class Store:
    """The tables built from one directory in one session; they go when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.schemas, self.counts = spark, {}, {}, {}
        self.root = f"{_folder(spark)}/core-{uuid.uuid4().hex}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)

    def table(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """The table, built if it isn't there. Rows of a file are in the order of `by`, so that filters on it skip most of a large file."""
        if name not in self.paths:
            df, path = build(), f"{self.root}/{name}"
            (df.sortWithinPartitions(by) if by else df).write.parquet(path)
            self.schemas[name], self.paths[name] = df.schema, path
        return self.spark.read.schema(self.schemas[name]).parquet(self.paths[name])

    def rows(self, name: str) -> int:
        """The rows of a built table, from the footers of its files."""
        if name not in self.counts:
            self.counts[name] = self.spark.read.schema(self.schemas[name]).parquet(self.paths[name]).count()
        return self.counts[name]

    def file(self, name: str, write: Callable[[str], None]) -> str:
        """The path of a file of the outside world, written if it isn't there."""
        if name not in self.paths:
            path = f"{self.root}/{name}"
            write(path)
            self.paths[name] = path
        return self.paths[name]


_stores: dict[tuple[str, str], Store] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = Store(spark)
    return _stores[key]
