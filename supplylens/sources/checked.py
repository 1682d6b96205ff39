"""Appends that are checked first: declared keys, domains and references, and a commit by one rename.

Rows are written to a folder that readers don't see, checked there against the rows that are there already,
and made visible by renaming the folder; if a check fails, or the driver dies, nothing is seen. Two writers
that append the same key at the same moment both pass: let one writer append to a table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Violation(ValueError):
    """Rows that break a constraint."""


@dataclass(frozen=True)
class Constraints:
    """key: unique and not null; required: not null; domains: the values of a column; references: (other table's rows, its column)."""

    key: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    references: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def violations(rows: DataFrame, c: Constraints, before: DataFrame | None = None) -> dict[str, int]:
    """How many rows (for keys: keys) break each constraint: one aggregation by key and one over all."""
    key = list(c.key) or ["_none"]
    x = rows if c.key else rows.withColumn("_none", F.lit(0))
    for name, (other, column) in c.references.items():
        known = other.select(F.col(column).alias(f"_{name}")).distinct().withColumn(f"_has_{name}", F.lit(True))
        x = x.join(known, F.col(name) == F.col(f"_{name}"), "left").drop(f"_{name}")
    tests = {f"{n} is null": F.col(n).isNull() for n in (*c.key, *c.required)}
    tests |= {f"{n} is none of {', '.join(v)}": F.col(n).isNotNull() & ~F.col(n).isin(*v) for n, v in c.domains.items()}
    tests |= {f"{n} is not there": F.col(n).isNotNull() & F.col(f"_has_{n}").isNull() for n in c.references}
    flags = [F.when(t, 1).otherwise(0).alias(f"_{k}") for k, t in enumerate(tests.values())]
    new = x.select(*key, F.lit(1).alias("_new"), F.lit(0).alias("_old"), *flags)
    if before is not None and c.key:
        new = new.unionByName(before.select(*key, F.lit(0).alias("_new"), F.lit(1).alias("_old"), *(F.lit(0).alias(f"_{k}") for k in range(len(flags)))))
    by_key = new.groupBy(*key).agg(*(F.sum(n).alias(n) for n in ("_new", "_old", *(f"_{k}" for k in range(len(flags))))))
    twice = (F.col("_new") > 1) | (F.col("_new") > 0) & (F.col("_old") > 0)
    row = by_key.agg(F.count(F.when(twice, 1)).alias("_twice"), *(F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(f"_{k}") for k in range(len(flags)))).first()
    found = {name: row[f"_{k}"] for k, name in enumerate(tests)}
    if c.key:
        found[f"{', '.join(c.key)} is there twice"] = row["_twice"]
    return {k: n for k, n in found.items() if n}


class Staged:
    """Rows that wait, checked, for commit() or discard()."""

    def __init__(self, rows: DataFrame, path: str, c: Constraints):
        self.spark, self.path, self.id = rows.sparkSession, path.rstrip("/"), uuid.uuid4().hex
        self.hidden = f"{self.path}/_staged_{self.id}"
        rows.write.parquet(self.hidden)
        try:
            found = violations(self.spark.read.schema(rows.schema).parquet(self.hidden), c, existing(self.spark, self.path))
        except Exception:
            self.discard()
            raise
        if found:
            self.discard()
            raise Violation("; ".join(f"{n} x {k}" for k, n in found.items()))

    def _files(self):
        paths = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        where = paths(self.hidden)
        return paths, where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commit(self) -> str:
        paths, where, system = self._files()
        if not system.rename(where, paths(f"{self.path}/batch={self.id}")):
            raise OSError(f"{self.hidden} could not be made visible")
        return self.id

    def discard(self) -> None:
        _, where, system = self._files()
        system.delete(where, True)


def append(rows: DataFrame, path: str, c: Constraints) -> str:
    """Check the rows and make them visible at once; returns the batch's id."""
    return Staged(rows, path, c).commit()
