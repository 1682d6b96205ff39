"""Matching of returned units with the lots that they came from, latest lot first.

A lot is a line of a sale with its units; a return takes units left in lots of its client and item that
were shipped on earlier days, the latest first. Lots and returns of a group (client, item) are events
in order of their day, on a day returns before lots, and lots in reverse of the order in which they are
taken, so that what a return takes next always is the lot that came last.

1. Events are dealt by ranges of that order, so a giant group spreads over many tasks and each task has
   fragments of groups that follow each other. In a task an external priority queue (ExternalQueue)
   puts events in order: a bounded insertion buffer, sorted Arrow runs that are spilled when it is full,
   and blocks of the runs merged as events are taken. Returns then take from a stack whose lower part is
   spilled as well (Stack), so a fragment of any size streams through constant memory.
2. Only the first and the last group of a task can go on in other tasks. Of these the task also gives
   the lots that are left and the returns that found too little, both with their places in the
   fragment's row of units. Fragments are linked by their sums alone (link): which units of an
   earlier fragment the returns of a later one take. Windows then cut the two rows of units into pieces;
   no task has more than two fragments.

Cases: rows without a client, item, amount, shipping time or quantity, without a sale, with a quantity
below 1 or an amount that isn't below 10^13 in size (or not a number) are no lots; a missing or non-finite
discount is none; a missing line number comes first, stays null and is empty text in the checksum;
repeated rows are lots of their own; times within a day don't count; empty tables give no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.llm.common import bounded_batches, durable, fresh_path, read

#: Rows in the insertion buffer, in a block of a run, and runs that are merged at once.
BUFFER, BLOCK, FAN = 1 << 18, 1 << 13, 16
#: Lots of the stack that stay in memory.
HELD = 1 << 16
#: Rows of a batch that a task gives.
OUT = 20_000
MOST = 1e13
NO_LINE = -(1 << 40)
GROUP = ["client_id", "item_id"]
EVENT = [*GROUP, "turn", "sale", "line", "q", "c", "d", "units"]
KEYS = 8
DONE, FIRST, LOT, SHORT, SUMS = range(5)
ROW = [*GROUP, "part", "no", "piece", "day", "sale", "lot_sale", "lot_line", "q", "c", "d", "units", "at", "left", "refund", "margin"]


def _scratch():
    """A file without a name in the space that Spark gives its tasks for spilling; it goes with the task."""
    return tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)


class _Run:
    """A sorted run on disk, of which one block is in memory."""

    def __init__(self, blocks: Iterator[list[np.ndarray]]):
        self.file = _scratch()
        writer = None
        for block in blocks:
            batch = pa.RecordBatch.from_arrays([pa.array(x) for x in block], [str(k) for k in range(len(block))])
            writer = writer or pa.ipc.new_stream(self.file, batch.schema)
            writer.write_batch(batch)
        if writer:
            writer.close()
        self.file.seek(0)
        self.reader = pa.ipc.open_stream(self.file) if writer else iter(())
        self.step()

    def step(self) -> None:
        batch = next(iter(self.reader), None)
        self.block = None if batch is None else [x.to_numpy() for x in batch.columns]
        if batch is None:
            self.file.close()


class ExternalQueue:
    """A priority queue of rows of int64 columns, of which the first `keys` are the order.

    push() and pop() may come in any order. What is pushed stays in a buffer; a full buffer becomes a
    sorted run on disk. pop() gives the least rows, a block or so at a time, and holds one block of
    each run; when there are many runs they are merged into one.
    """

    def __init__(self, columns: int, keys: int, buffer: int = BUFFER, block: int = BLOCK, fan: int = FAN):
        self.columns, self.keys, self.buffer, self.size, self.fan = columns, keys, buffer, block, fan
        self.new: list[list[np.ndarray]] = []
        self.count = 0
        self.head: list[np.ndarray] | None = None  # what of the buffer is sorted
        self.runs: list[_Run] = []

    def _order(self, rows: list[np.ndarray]) -> np.ndarray:
        """The order of rows: by the first keys, then by all where these tie."""
        few = min(4, self.keys)
        order = np.lexsort([rows[k] for k in range(few - 1, -1, -1)])
        if few < self.keys and len(order) > 1:
            same = np.ones(len(order) - 1, bool)
            for k in range(few):
                x = rows[k][order]
                same &= x[1:] == x[:-1]
            if same.any():
                tied = np.zeros(len(order), bool)
                tied[1:] |= same
                tied[:-1] |= same
                at = np.flatnonzero(tied)
                group = np.cumsum(np.concatenate([[True], ~same]))[at]
                rest = order[at]
                order[at] = rest[np.lexsort([*(rows[k][rest] for k in range(self.keys - 1, few - 1, -1)), group])]
        return order

    def _sorted(self, parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = self._order(rows)
        return [x[order] for x in rows]

    def _blocks(self, rows: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        for at in range(0, len(rows[0]), self.size):
            yield [x[at : at + self.size] for x in rows]

    def push(self, rows: list[np.ndarray]) -> None:
        self.new.append(rows)
        self.count += len(rows[0])
        if self.count >= self.buffer:
            self.spill()

    def spill(self) -> None:
        parts = self.new + ([self.head] if self.head else [])
        self.new, self.head, self.count = [], None, 0
        if parts:
            self.runs.append(_Run(self._blocks(self._sorted(parts))))
        if len(self.runs) >= self.fan:
            merged = ExternalQueue(self.columns, self.keys, self.buffer, self.size, self.fan)
            merged.runs, self.runs = self.runs, []
            self.runs = [_Run(block for rows in merged.drain() for block in merged._blocks(rows))]

    def drain(self) -> Iterator[list[np.ndarray]]:
        while (rows := self.pop()) is not None:
            yield rows

    def _upto(self, rows: list[np.ndarray], bound: tuple) -> int:
        keys = rows[: self.keys]
        return bisect_right(range(len(rows[0])), bound, key=lambda i: tuple(x[i] for x in keys))

    def pop(self) -> list[np.ndarray] | None:
        """The least rows in order, at least one if there are any; None if there are none."""
        if self.new:
            self.head, self.new, self.count = self._sorted(self.new + ([self.head] if self.head else [])), [], 0
        self.runs = [r for r in self.runs if r.block is not None]
        if not self.runs:
            if not self.head or not len(self.head[0]):
                self.head = None
                return None
            got, self.head = [x[: self.size] for x in self.head], [x[self.size :] for x in self.head]
            return got
        # Up to the least end of a block every row is in memory.
        bound = min(tuple(int(x[-1]) for x in r.block[: self.keys]) for r in self.runs)
        parts = []
        for r in self.runs:
            n = self._upto(r.block, bound)
            parts.append([x[:n] for x in r.block])
            if n == len(r.block[0]):
                r.step()
            else:
                r.block = [x[n:] for x in r.block]
        if self.head:
            n = self._upto(self.head, bound)
            parts.append([x[:n] for x in self.head])
            self.head = [x[n:] for x in self.head] if n < len(self.head[0]) else None
        return self._sorted(parts)


class Stack:
    """Lots as (sale, line, q, c) with the units left; only the upper ones are in memory."""

    def __init__(self, held: int = HELD):
        self.lots: list[tuple[int, int, int, int]] = []
        self.left: list[int] = []
        self.held, self.file, self.places = held, None, []

    def trim(self) -> None:
        """Spill the lower half when too many are in memory."""
        if len(self.lots) > self.held:
            n = self.held // 2
            self.file = self.file or _scratch()
            self.file.seek(self.places[-1][1] if self.places else 0)
            at = self.file.tell()
            rows = np.array([(*lot, k) for lot, k in zip(self.lots[:n], self.left[:n], strict=True)], np.int64)
            with pa.ipc.new_stream(self.file, (batch := pa.RecordBatch.from_arrays([pa.array(x) for x in rows.T.copy()], list("slqcn"))).schema) as out:
                out.write_batch(batch)
            self.places.append((at, self.file.tell()))
            del self.lots[:n], self.left[:n]

    def fill(self) -> bool:
        """Read the next lower lots when none is in memory; whether there are any."""
        if not self.lots and self.places:
            self.file.seek(self.places.pop()[0])
            *lot, left = (x.to_pylist() for x in pa.ipc.open_stream(self.file).read_next_batch().columns)
            self.lots[:], self.left[:] = zip(*lot, strict=True), left
        return bool(self.lots)

    def clear(self) -> None:
        self.lots.clear()
        self.left.clear()
        self.places = []


class _Output:
    """Rows of one kind, as columns that not every kind has."""

    def __init__(self, kind: int, names: list[str]):
        self.kind, self.names, self.rows = kind, names, []

    def batch(self) -> pa.RecordBatch:
        n, columns = len(self.rows), dict(zip(self.names, zip(*self.rows, strict=True), strict=True))
        self.rows.clear()
        values = [pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(n, pa.int64()) for c in ROW]
        return pa.RecordBatch.from_arrays([*values, pa.array(np.full(n, self.kind, np.int32))], [*ROW, "kind"])


def _matcher(buffer: int, block: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        queue = ExternalQueue(len(EVENT), KEYS, buffer, block)
        for batch in batches:
            queue.push([x.to_numpy(zero_copy_only=False) for x in batch.columns])
        yield from match(queue, TaskContext.get().partitionId(), held)

    return run


def _needed(rows: list[np.ndarray], change: np.ndarray) -> np.ndarray:
    """Which events of a block may matter: of groups that begin and end in it, those up to the last return."""
    group = np.cumsum(change)
    is_return = (rows[2] & 1) == 0
    last = np.full(group[-1] + 1, -1)
    at = np.flatnonzero(is_return)
    last[group[at]] = at  # the last one stays
    keep = np.arange(len(group)) <= last[group]
    return keep | (group == group[-1]) | (group == 0)


def match(queue: ExternalQueue, part: int, held: int = HELD, out: int = OUT) -> Iterator[pa.RecordBatch]:
    """The pieces of one task's fragments, and what fragments in other tasks have to know."""
    piece = ["client_id", "item_id", "part", "no", "piece", "day", "sale", "lot_sale", "lot_line", "units", "left", "refund", "margin"]
    done, first = _Output(DONE, piece), _Output(FIRST, piece)
    short = _Output(SHORT, ["client_id", "item_id", "part", "no", "piece", "day", "sale", "q", "c", "d", "units", "at", "left"])
    sums = _Output(SUMS, ["client_id", "item_id", "part", "no", "units", "left"])
    outputs = (done, first, short, sums)
    stack = Stack(held)
    lots, left = stack.lots, stack.left
    group, at_first, no, lacking = None, True, 0, 0
    rows_out, shorts = first.rows, short.rows
    while (rows := queue.pop()) is not None:
        client, item = rows[0], rows[1]
        change = np.concatenate([[(int(client[0]), int(item[0])) != group], (client[1:] != client[:-1]) | (item[1:] != item[:-1])])
        keep = _needed(rows, change)
        # A group whose first event isn't needed begins with the first one that is.
        which = np.cumsum(change)[keep]
        begin = np.concatenate([[bool(change[0]) or not keep[0]], which[1:] != which[:-1]]) if len(which) else which
        for new, cl, it, turn, s, ln, q, c, d, units in zip(begin.tolist(), *(x[keep].tolist() for x in rows), strict=True):
            if new:
                if group is not None and at_first:
                    sums.rows.append((*group, part, no, lacking, 0))
                    at_first, rows_out = False, done.rows
                group, no, lacking = (cl, it), 0, 0
                stack.clear()
            if turn & 1:
                lots.append((~s, ~ln, ~q, ~c))
                left.append(units)
                if len(lots) > held:
                    stack.trim()
                continue
            no += 1
            day, number, taken, per, most = turn >> 1, 0, 0, c * (100 - d), 100 * q
            refunded = 0
            while taken < units and (lots or stack.fill()):
                lot_s, lot_l, lot_q, lot_c = lots[-1]
                have = left[-1]
                n = units - taken
                if have <= n:
                    n, rest = have, 0
                    lots.pop()
                    left.pop()
                else:
                    rest = left[-1] = have - n
                taken += n
                number += 1
                upto, before = taken * per // most, lot_q - have
                cost = (before + n) * lot_c // lot_q - before * lot_c // lot_q
                rows_out.append((cl, it, part, no, number, day, s, lot_s, None if lot_l == NO_LINE else lot_l, n, rest, upto - refunded, upto - refunded - cost))
                refunded = upto
            if taken < units:
                if at_first:
                    shorts.append((cl, it, part, no, number, day, s, q, c, d, units - taken, lacking, taken))
                    lacking += units - taken
                else:
                    rows_out.append((cl, it, part, no, number + 1, day, s, None, None, units - taken, None, units * per // most - refunded, None))
        for o in outputs:
            if len(o.rows) >= out:
                yield o.batch()
    if group is None:
        return
    # What is left of the last group: from the top of the stack down, with its place among the units left.
    own, at = _Output(LOT, ["client_id", "item_id", "part", "lot_sale", "lot_line", "q", "c", "at", "left"]), 0
    while stack.fill():
        for lot, n in zip(reversed(lots), reversed(left), strict=True):
            own.rows.append((*group, part, lot[0], None if lot[1] == NO_LINE else lot[1], lot[2], lot[3], at, n))
            at += n
            if len(own.rows) >= out:
                yield own.batch()
        lots.clear()
        left.clear()
    sums.rows.append((*group, part, no, lacking, at))
    for o in (*outputs, own):
        if o.rows:
            yield o.batch()


def link(rows: pd.DataFrame) -> pd.DataFrame:
    """Which units that returns of a fragment lack are taken from which earlier fragment.

    rows: the sums of one group's fragments, one row for each task that the group spreads over. A row of
    the result: n units from `x` on of those that fragment `part` lacks are the n units from `y` on (counted
    from the latest) of those left in fragment `source`; without a source there are none.
    """
    found, stack = [], []
    rows = rows.sort_values("part")
    client, item = rows["client_id"].iloc[0], rows["item_id"].iloc[0]
    for part, lacking, left in zip(rows["part"].tolist(), rows["units"].tolist(), rows["left"].tolist(), strict=True):
        x = 0
        while x < lacking and stack:
            source, y, have = stack.pop()
            n = min(have, lacking - x)
            found.append((client, item, part, source, x, y, n))
            x += n
            if n < have:
                stack.append((source, y + n, have - n))
        if x < lacking:
            found.append((client, item, part, None, x, 0, lacking - x))
        if left:
            stack.append((part, 0, left))
    out = pd.DataFrame(found, columns=[*GROUP, "part", "source", "x", "y", "n"])
    return out.astype({"source": "Int64"})


def _whole(n: Column, value: Column, size: Column) -> Column:
    """floor(n * value / size) in whole numbers."""
    rest = F.pmod(value, size)
    return n * _div(value - rest, size) + _div(n * rest - F.pmod(n * rest, size), size)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _across(kept: dict[int, DataFrame]) -> DataFrame:
    """Pieces of returns that take from other tasks' fragments, or find nothing there."""
    key = [*GROUP, "part"]
    links = kept[SUMS].groupBy(*GROUP).applyInPandas(link, "client_id long, item_id long, part long, source long, x long, y long, n long")
    links = durable(links, "lot-links")
    s, k = kept[SHORT].alias("s"), links.alias("k")
    same = lambda a, b, cols: [F.col(f"{a}.{c}") == F.col(f"{b}.{d}") for c, d in cols]
    own = [(c, c) for c in key]
    low = F.greatest(F.col("s.at"), F.col("k.x"))
    high = F.least(F.col("s.at") + F.col("s.units"), F.col("k.x") + F.col("k.n"))
    asked = s.join(k, same("s", "k", own)).where(low < high).select(
        *(F.col(f"s.{c}") for c in key), "k.source", (low - F.col("k.x")).alias("w"), (high - low).alias("n"), F.col("k.x").alias("x"),
        F.struct(*(F.col(f"s.{c}") for c in ("no", "piece", "day", "sale", "q", "c", "d", "at", "left", "units"))).alias("r"),
    )
    lot, near = kept[LOT].alias("s"), [(c, c) for c in GROUP] + [("part", "source")]
    low, high = F.greatest(F.col("s.at"), F.col("k.y")), F.least(F.col("s.at") + F.col("s.left"), F.col("k.y") + F.col("k.n"))
    given = lot.join(k, same("s", "k", near)).where(low < high).select(
        *(F.col(f"s.{c}") for c in GROUP), F.col("k.part").alias("part"), "k.source", (low - F.col("k.y")).alias("w"),
        F.struct("s.lot_sale", "s.lot_line", "s.q", "s.c", "s.at", "s.left", "k.y").alias("l"),
    )
    # Both cover the same units of a link; a piece goes from one start to the next of either kind.
    taken = asked.where("source IS NOT NULL").drop("n").unionByName(given, allowMissingColumns=True)
    w = Window.partitionBy(*key, "source").orderBy("w")
    upto, size = w.rowsBetween(Window.unboundedPreceding, 0), links.select(*key, "source", "n")
    taken = taken.select(*key, "source", "w", F.last("r", True).over(upto).alias("r"), F.last("x", True).over(upto).alias("x"), F.last("l", True).over(upto).alias("l"), F.lead("w").over(w).alias("next"))
    taken = taken.join(size, [*key, "source"]).withColumn("n", F.coalesce("next", "n") - F.col("w")).where("n > 0").drop("next", "source")
    none = asked.where("source IS NULL").drop("source").withColumn("l", F.lit(None).cast(taken.schema["l"].dataType))
    rows = taken.unionByName(none)
    n0 = F.col("r.left") + F.col("x") + F.col("w") - F.col("r.at")
    refund = lambda n: _whole(n, F.col("r.c") * (100 - F.col("r.d")), 100 * F.col("r.q"))
    rows = rows.withColumn("n0", n0).withColumn("t0", F.col("l.q") - F.col("l.left") + F.col("l.y") + F.col("w") - F.col("l.at"))
    cost = lambda n: _whole(n, F.col("l.c"), F.col("l.q"))
    number = F.row_number().over(Window.partitionBy(*key, F.col("r.no")).orderBy("n0"))
    back = refund(F.col("n0") + F.col("n")) - refund(F.col("n0"))
    return rows.select(
        *key, F.col("r.no").alias("no"), (F.col("r.piece") + number).alias("piece"), F.col("r.day").alias("day"), F.col("r.sale").alias("sale"), F.col("l.lot_sale").alias("lot_sale"), F.col("l.lot_line").alias("lot_line"),
        F.col("n").alias("units"), (F.col("l.q") - F.col("t0") - F.col("n")).alias("left"), back.alias("refund"), (back - (cost(F.col("t0") + F.col("n")) - cost(F.col("t0")))).alias("margin"),
    )


def events(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """Lots and returns as rows of whole numbers whose order is that of the first columns."""
    sale = sales.select(F.col("sale_id").cast("long").alias("sale"), F.col("client_id").cast("long").alias("client_id")).where("sale IS NOT NULL AND client_id IS NOT NULL")
    amount, discount = F.col("amount").cast("double"), F.col("discount").cast("double")
    usable = F.col("sale_id").isNotNull() & F.col("item_id").isNotNull() & (F.col("quantity") >= 1) & (F.abs(amount) < MOST) & F.col("shipped_at").isNotNull()
    line = F.col("line_no").cast("long")
    low = F.coalesce(F.abs(discount) < MOST, F.lit(False))
    x = lines.where(usable).select(
        F.col("sale_id").cast("long").alias("sale"), F.coalesce(line, F.lit(NO_LINE)).alias("line"), F.col("item_id").cast("long").alias("item_id"), F.col("quantity").cast("long").alias("q"),
        F.floor(100 * amount + F.lit(0.5)).alias("c"), F.when(low, F.floor(100 * discount + F.lit(0.5))).otherwise(F.lit(0)).alias("d"),
        F.datediff(F.col("shipped_at").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.coalesce(F.col("flag") == "returned", F.lit(False)).alias("back"),
        F.crc32(F.concat_ws(":", F.col("sale_id").cast("long").cast("string"), F.coalesce(line.cast("string"), F.lit("")))).alias("h"),
    ).join(sale, "sale")
    no = F.bitwise_not
    lot = F.struct((2 * F.col("day") + 1).alias("turn"), *(no(F.col(c)).alias(c) for c in ("sale", "line", "q", "c", "d")), F.col("q").alias("units"))
    back = F.struct((2 * (F.col("day") + 1 + F.col("h") % 13)).alias("turn"), *(F.col(c).alias(c) for c in ("sale", "line", "q", "c", "d")), (1 + F.col("h") % (F.col("q") + 10)).alias("units"))
    return x.select(*GROUP, F.explode(F.when(F.col("back"), F.array(lot, back)).otherwise(F.array(lot))).alias("e")).select(*GROUP, "e.*").select(*EVENT)


def match_returns(lines: DataFrame, sales: DataFrame, buffer: int = BUFFER, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """The pieces of all returns: client_id, item_id, return_no, piece_no, return_day, return_sale_id,
    lot_sale_id, lot_line_no, units, lot_left, refund_cents, margin_cents."""
    spark = lines.sparkSession
    bounded_batches(spark, 10_000)
    dealt = events(lines, sales).repartitionByRange(*EVENT[:KEYS])
    schema = ", ".join(f"{c} long" for c in ROW) + ", kind int"
    path = fresh_path(spark, "lots")
    dealt.mapInArrow(_matcher(buffer, block, held), schema).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    kept = {k: stored.where(F.col("kind") == k).drop("kind") for k in range(5)}
    piece = [*GROUP, "part", "no", "piece", "day", "sale", "lot_sale", "lot_line", "units", "left", "refund", "margin"]
    before = F.coalesce(F.sum("no").over(Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = kept[SUMS].select(*GROUP, "part", before.alias("before"))
    moved = kept[FIRST].select(*piece).unionByName(_across(kept)).join(starts, [*GROUP, "part"]).withColumn("no", F.col("no") + F.col("before"))
    found = kept[DONE].select(*piece).unionByName(moved.select(*piece))
    return found.select(
        *GROUP, F.col("no").alias("return_no"), F.col("piece").cast("long").alias("piece_no"), F.col("day").alias("return_day"), F.col("sale").alias("return_sale_id"), F.col("lot_sale").alias("lot_sale_id"),
        F.col("lot_line").alias("lot_line_no"), "units", F.col("left").alias("lot_left"), F.col("refund").alias("refund_cents"), F.col("margin").alias("margin_cents"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_returns(read(spark, sf_dir, "sale_lines"), read(spark, sf_dir, "sales"))


QUERIES = {"op13_external_queue_lots": query}
ORACLES: dict[str, str] = {}
