"""Best-fit packing of documents into sequences, after Martello-Toth reduction.

Pieces of documents are items whose sizes are integers up to the capacity, so an instance is the
number of items of each size: at most `capacity` numbers, however many documents there are.
Those are gathered on the driver, where the packing is planned as kinds of sequences:

1. Reduction. For an item j and the largest item k that fits beside it, the set {j, k} dominates
   all others that hold j if the two fill the sequence, if no two items fit beside j, or if at most
   two do and no such pair outweighs k; an item beside which nothing fits stands alone. Such sets
   are fixed for good and the instance shrinks, until no item is dominated.
2. The rest goes by best fit, largest first.

Every piece then finds its place by its rank among the pieces of its size.

Cases: a null or empty text is its end id alone; repeated and null ids are separate rows with
places of their own; ties of size are numbered by id, piece and content; an empty table packs into
nothing; texts are never truncated, longer ones are cut into whole sequences with the shorter piece
first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.common import bounded_batches, durable, give_back, ranked, read
from supplylens.llm.tokens import default_path, encoder

CAPACITY, END = 2048, 0

#: Sequences of one kind: how many there are, and (size, copies) of the items in each.
Kind = tuple[int, list[tuple[int, int]]]


class _Sizes:
    """The items left, by size."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for size, count in counts.items():
            if not 1 <= size <= capacity:
                raise ValueError(f"size {size}")
            self.n[size] += count

    def take(self, size: int, count: int = 1) -> None:
        self.n[size] -= count

    def largest(self, most: int) -> int:
        """The largest size left that isn't over `most`, 0 if there is none."""
        left = np.flatnonzero(self.n[: max(most, 0) + 1])
        return int(left[-1]) if len(left) else 0

    def smallest(self, k: int) -> list[int]:
        found: list[int] = []
        for size in np.flatnonzero(self.n)[:k]:
            found += [int(size)] * min(int(self.n[size]), k - len(found))
            if len(found) == k:
                break
        return found


def _heaviest_pair(left: _Sizes, room: int) -> int:
    """The largest sum of two items left that isn't over `room`, 0 if none fits."""
    sizes = np.flatnonzero(left.n[: max(room, 0) + 1])
    if not len(sizes):
        return 0
    at = np.searchsorted(sizes, room - sizes, side="right") - 1
    mate = np.where(at >= 0, sizes[np.maximum(at, 0)], 0)
    own = (mate == sizes) & (left.n[sizes] < 2)  # one item is no pair with itself
    mate = np.where(own, np.where(at > 0, sizes[np.maximum(at - 1, 0)], 0), mate)
    sums = np.where(mate > 0, sizes + mate, 0)
    return int(sums.max())


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[Kind], dict[int, int]]:
    """The sequences that dominance fixes, and what is left."""
    left, fixed, changed = _Sizes(counts, capacity), [], True
    while changed:
        changed = False
        for j in map(int, np.flatnonzero(left.n)[::-1]):
            if not left.n[j]:
                continue
            left.take(j)
            few, k = left.smallest(3), left.largest(capacity - j)
            if not k:
                left.take(j, -1)
                n, alone = int(left.n[j]), True  # nothing else fits beside any of this size
                fixed.append((n, [(j, 1)]))
                left.take(j, n)
                changed = True
                continue
            full = j + k == capacity
            one = len(few) < 2 or j + few[0] + few[1] > capacity
            two = (len(few) < 3 or j + sum(few) > capacity) and _heaviest_pair(left, capacity - j) <= k
            left.take(j, -1)
            if full or one or two:
                n = int(left.n[j]) // 2 if j == k else int(min(left.n[j], left.n[k]))
                fixed.append((n, [(j, 2)] if j == k else [(j, 1), (k, 1)]))
                left.take(j, n)
                left.take(k, n)
                changed = True
    return fixed, {int(s): int(left.n[s]) for s in np.flatnonzero(left.n)}


def best_fit(counts: dict[int, int], capacity: int) -> list[Kind]:
    """Best fit, largest first, with sequences of one kind handled together."""
    room: list[list[Kind]] = [[] for _ in range(capacity + 1)]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for r in range(size, capacity + 1):
            # The fullest sequence takes items until none fits: it stays the fullest.
            each = r // size
            while left and room[r]:
                n, held = room[r].pop()
                filled = min(n, left // each)
                if filled:
                    room[r - each * size].append((filled, [*held, (size, each)]))
                    left -= filled * each
                    n -= filled
                if n and left:
                    room[r - left * size].append((1, [*held, (size, left)]))
                    left, n = 0, n - 1
                if n:
                    room[r].append((n, held))
        each = capacity // size
        if left // each:
            room[capacity - each * size].append((left // each, [(size, each)]))
        if left % each:
            room[capacity - left % each * size].append((1, [(size, left % each)]))
    return [kind for kinds in room for kind in kinds]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Kind]:
    fixed, rest = reduce(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """Where the items of each size go: runs of ranks that fill one kind of sequence."""

    def __init__(self, kinds: list[Kind]):
        runs: list[tuple[int, int, int, int, int]] = []
        used: dict[int, int] = {}
        sequence = 0
        for n, items in kinds:
            offset = 0
            for size, copies in items:
                runs.append((size, used.get(size, 0), sequence, copies, offset))
                used[size] = used.get(size, 0) + n * copies
                offset += size * copies
            sequence += n
        runs.sort()
        table = np.array(runs, np.int64).reshape(-1, 5)
        self.size, self.rank, self.sequence, self.copies, self.offset = table.T
        self.key = (self.size << 48) + self.rank

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (size.astype(np.int64) << 48) + rank, side="right") - 1
        past = rank - self.rank[at]
        return self.sequence[at] + past // self.copies[at], self.offset[at] + past % self.copies[at] * size


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, the shorter piece first."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _cutter(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        enc, last = encoder(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            ids, piece, start, length, raw = [], [], [], [], []
            for doc, data in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                data += last
                for k, (at, n) in enumerate(cut(len(data) // 4, capacity)):
                    ids.append(doc)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    raw.append(data[4 * at : 4 * (at + n)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary())],
                ["id", "piece", "start", "length", "ids"],
            )

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, end: int = END, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' pieces: id, piece, start, length and ids (binary, little-endian 32-bit)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    run = _cutter(tokenizer or default_path("byte_bpe_50k.json"), end, capacity)
    found = rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids binary")
    return found.withColumnRenamed("id", id_col)


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored rows that have a `length`; `order` breaks ties."""
    # At most `capacity` rows come to the driver.
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(plan(counts, capacity))
    at = ranked(items, ["length"], [F.col(c) for c in order], "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            sequence, offset = places.of(size, rank.astype(np.int64))
            keep = [k for k, f in enumerate(batch.schema) if f.name != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                [*(batch.schema.field(k).name for k in keep), "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return at.select(*items.columns, F.col("_rank").cast("long")).mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces without their ids but with their crc32, and their places."""
    cut_up = pieces(docs, tokenizer).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(durable(cut_up, "pieces"), ["doc_id", "piece", "ids_crc32"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": query}
ORACLES: dict[str, str] = {}
