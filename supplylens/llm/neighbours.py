"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are projected on Gaussian directions and cut into cells of width `width`; a table's
bucket is the cells of its `functions` projections. A query visits `probes` buckets of each table in
the order of estimated success: the sum over the functions of the squared distance to the cell, so
the own bucket comes first and then those across the nearest cell walls. The candidates of all
tables are merged and ranked by their exact cosine on the original vectors.

Buckets are cut into blocks of at most `block` vectors, and their visitors likewise, so that a
bucket of near copies is searched by many tasks.

Cases: vectors that are null, empty, zero, of another length than the longest, or with null or
non-finite parts take no part; rows with a null id neither; repeated ids are separate candidates,
save that a query skips every row with its own id; ties go to the smaller id; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.llm.common import bounded_batches, durable, read

#: Reach a recall of 0.9 or more on vectors without any structure; structured ones need fewer probes.
TABLES, FUNCTIONS, WIDTH, PROBES = 3, 5, 0.25, 90
REACH = 4  # cells on either side of zero; the outermost hold all beyond
BLOCK = 4000
SLACK = 1e-10  # more than a product of unit vectors can be off
QUERY_STEP, NEAREST = 50, 5


class Tables:
    def __init__(self, dim: int, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((tables, dim, functions)) / np.sqrt(dim)
        self.width = width * 8 / np.sqrt(dim)  # in spreads of a projection: two at 0.25
        self.shift = rng.uniform(0, 1, (tables, functions))
        self.probes, self.functions, self.tables = probes, functions, tables

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Where the projections lie, in cells, the leftmost cell from 0 to 1."""
        return np.clip(unit @ self.directions[table] / self.width + self.shift[table] + REACH, 0, 2 * REACH - 1e-9)

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(unit), np.int64)
        for cell in np.floor(self.cells(unit, table)).astype(np.int64).T:
            code = code * 2 * REACH + cell
        return code

    def visits(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The buckets to visit, nearest first: partial sums only grow, so the best of all
        combinations extend the best of the functions so far."""
        at, cell = self.cells(unit, table), np.arange(2 * REACH)
        cost = np.maximum(0, np.maximum(cell - at[:, :, None], at[:, :, None] - cell - 1)) ** 2
        best, code = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
        for m in range(self.functions):
            best = (best[:, :, None] + cost[:, m, None, :]).reshape(len(unit), -1)
            code = (code[:, :, None] * 2 * REACH + cell).reshape(len(unit), -1)
            first = np.argsort(best, axis=1, kind="stable")[:, : self.probes]
            best, code = np.take_along_axis(best, first, 1), np.take_along_axis(code, first, 1)
        return code


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.sum(x * x, axis=1))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): the vectors that take part, as doubles."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0))


def _hasher(tables: Tables, probe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            top = np.abs(x).max(axis=1, keepdims=True)  # against overflow and underflow
            unit = x / top
            unit /= _norms(unit)[:, None]
            for table in range(tables.tables):
                code = tables.visits(unit, table) if probe else tables.buckets(unit, table)[:, None]
                for a in range(0, len(x), 64):
                    part = code[a : a + 64]
                    take = pa.array(np.repeat(np.arange(a, a + len(part)), part.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.size, table), pa.int32()), pa.array(part.ravel(), pa.int64()), batch.column(0).take(take), batch.column(1).take(take)],
                        ["t", "bucket", "id", "x"],
                    )

    return run


def _search(nearest: int):
    def run(key, vectors: pa.Table, visitors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and visitors.num_rows:
            ids, x = vectors["id"].to_numpy(), _matrix(vectors["x"].combine_chunks())
            qids, q = visitors["id"].to_numpy(), _matrix(visitors["x"].combine_chunks())
            sx, sq = np.abs(x).max(axis=1), np.abs(q).max(axis=1)
            x, q = x / sx[:, None], q / sq[:, None]
            nx, nq = _norms(x), _norms(q)
            for a in range(0, len(q), 256):
                near = (q[a : a + 256] / nq[a : a + 256, None]) @ (x / nx[:, None]).T
                near[qids[a : a + 256, None] == ids[None, :]] = -np.inf
                least = np.partition(near, -nearest, axis=1)[:, -nearest] if near.shape[1] > nearest else np.full(len(near), -2.0)
                for k, row in enumerate(near, a):
                    # The product's last digits depend on the place, so all within them are measured.
                    some = np.flatnonzero((row >= least[k - a] - SLACK) & (row > -np.inf))
                    score = np.sum(x[some] * q[k], axis=1) / (nx[some] * nq[k])
                    first = np.lexsort((ids[some], -score))[:nearest]
                    out.append((np.full(len(first), qids[k]), ids[some[first]], score[first]))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.array([], np.int64), np.array([], np.int64), np.array([])]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, block: int = BLOCK, **options) -> DataFrame:
    """query_id, rank, vec_id and score; both frames have (id, x) as usable() gives them."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    dim = vectors.agg(F.max(F.size("x")).alias("d")).first()["d"]
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    tables = Tables(dim, **options)
    whole = F.size("x") == dim
    spec = "t int, bucket bigint, id bigint, x array<double>"
    index = vectors.where(whole).mapInArrow(_hasher(tables, False), spec)
    visits = queries.where(whole).mapInArrow(_hasher(tables, True), spec)
    # Rows of a bucket and of its visitors decide into how many blocks each is cut.
    held = index.groupBy("t", "bucket").agg(F.count("*").alias("held"))
    seen = visits.groupBy("t", "bucket").agg(F.count("*").alias("seen"))
    sizes = durable(held.join(seen, ["t", "bucket"]), "buckets")
    vs, qs = F.ceil(F.col("held") / block).cast("int"), F.ceil(F.col("seen") / block).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n, k: F.pmod(F.xxhash64("id", F.lit(k)), n).cast("int")
    index = index.join(sizes, ["t", "bucket"]).select("t", "bucket", own(vs, 1).alias("v"), span(qs).alias("q"), "id", "x")
    visits = visits.join(sizes, ["t", "bucket"]).select("t", "bucket", span(vs).alias("v"), own(qs, 2).alias("q"), "id", "x")
    key = ["t", "bucket", "v", "q"]
    found = index.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(_search(nearest), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.where(F.col("id") % QUERY_STEP == 0))


QUERIES = {"op7_multiprobe_lsh": query}
ORACLES: dict[str, str] = {}
