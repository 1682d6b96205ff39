"""Token-ID output as wavelet matrices.

Documents are encoded in ascending id order and cut into shards of whole documents. A shard
holds its ids as one wavelet matrix: a bit plane for each bit of an id, highest first; each
plane is followed by a stable partition of the ids by their bit. Planes are compressed by frames,
with the number of ones before each, so any id can be read, counted or found from a frame or two
of every plane. A shard is one such image, stored as a row of a Parquet file in the shared folder,
so that any store that Spark can write serves; counts, occurrences and ids at places of a whole
folder are jobs over its rows.

Cases: null or empty texts give the end id alone; rows with null ids come first; repeated ids
keep one entry per row; a text of any length is kept whole in one shard; an empty table gives no
shards; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.llm.common import bounded_batches, fresh_path, read
from supplylens.llm.tokens import default_path, encoder

MAGIC = b"WMX2"
FRAME = 1 << 16  # bits of a plane that are compressed together
HELD = 256  # frames that an open matrix keeps
SHARD_TOKENS = 2_000_000
RANGE = 1 << 20  # ids of a range by which places meet their shards
END = 2


class WaveletMatrix:
    """Ids of a shard as bit planes with rank and select, read from their compressed image.

    Planes are compressed by frames. The head of the image has the end of every frame and the ones
    before it, so that reading, counting or finding an id opens one or two frames of a plane.
    """

    def __init__(self, image: bytes):
        self.image = image
        self.n, self.bits = struct.unpack_from("<QB", image)
        self.frames = -(-self.n // FRAME)
        self.zeros = struct.unpack_from(f"<{self.bits}Q", image, 9)
        at, shape = 9 + 8 * self.bits, (self.bits, self.frames + 1)
        self.ones = np.frombuffer(image, "<u8", shape[0] * shape[1], at).astype(np.int64).reshape(shape)
        at += 8 * self.ones.size
        self.ends = np.frombuffer(image, "<u8", self.bits * self.frames, at).astype(np.int64)
        self.start = at + 8 * self.ends.size
        self.held: dict[int, np.ndarray] = {}
        self.unpack = zstandard.ZstdDecompressor().decompress

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind, n = np.uint16 if bits <= 16 else np.uint32, len(ids)
        x, pack = ids.astype(kind, copy=False), zstandard.ZstdCompressor(level=1).compress
        zeros, ones, parts = [], [], []
        for level in range(bits - 1, -1, -1):
            low, high, before = [], [], [0]
            for k in range(0, n, FRAME):  # a frame fits the caches of a core
                part = x[k : k + FRAME]
                bit = (part & kind(1 << level)) != 0
                parts.append(pack(np.packbits(bit, bitorder="little")))
                low.append(part.compress(~bit))
                high.append(part.compress(bit))
                before.append(before[-1] + len(high[-1]))
            ones.append(before)
            zeros.append(n - before[-1])
            x = np.concatenate([*low, *high]) if n else x
        ends = np.cumsum([len(p) for p in parts])
        head = struct.pack("<QB", n, bits) + struct.pack(f"<{bits}Q", *zeros) + np.concatenate(ones).astype("<u8").tobytes() + ends.astype("<u8").tobytes()
        return cls(head + b"".join(parts))

    def dump(self) -> bytes:
        return self.image

    load = classmethod(lambda cls, image: cls(image))

    def _open(self, at: int) -> np.ndarray:
        first = self.start + (int(self.ends[at - 1]) if at else 0)
        return np.frombuffer(self.unpack(self.image[first : self.start + int(self.ends[at])]), np.uint8)

    def _frame(self, level: int, k: int) -> np.ndarray:
        at = level * self.frames + k
        if at not in self.held:
            if len(self.held) >= HELD:
                self.held.clear()
            self.held[at] = self._open(at)
        return self.held[at]

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i."""
        k, rest = divmod(i, FRAME)
        found = int(self.ones[level, k])
        if rest:
            frame = self._frame(level, k)
            found += int(np.bitwise_count(frame[: rest >> 3]).sum(dtype=np.int64))
            if rest & 7:
                found += (int(frame[rest >> 3]) & ((1 << (rest & 7)) - 1)).bit_count()
        return found

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, r = int(self._frame(level, i // FRAME)[(i % FRAME) >> 3]) >> (i & 7) & 1, self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + r if bit else i - r
        return value

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at places, in any order."""
        i = np.asarray(places, np.int64)
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(int(i.min() if i.min() < 0 else i.max()))
        value = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            bit, rank = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
            for k, rows in _by_frame(i // FRAME):
                bits = np.unpackbits(self._frame(level, k), bitorder="little")
                at = i[rows] - k * FRAME
                bit[rows] = bits[at]
                rank[rows] = self.ones[level, k] + np.cumsum(bits, dtype=np.int64)[at] - bits[at]
            value = value << 1 | bit
            i = np.where(bit, self.zeros[level] + rank, i - rank)
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the value's occurrences before `end` lie below the last plane."""
        a, b = 0, end
        for level in range(self.bits):
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            if value >> (self.bits - 1 - level) & 1:
                a, b = self.zeros[level] + ra, self.zeros[level] + rb
            else:
                a, b = a - ra, b - rb
        return a, b

    def rank(self, value: int, end: int) -> int:
        """Occurrences of a value before a place."""
        if value < 0 or value >> self.bits:
            return 0
        a, b = self._range(value, end)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def find(self, value: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The places of the occurrences number `first` to `last` (excluded) of a value, ascending."""
        if value < 0 or value >> self.bits:
            return np.zeros(0, np.int64)
        a, b = self._range(value, self.n)
        i = np.arange(a + first, b if last is None else min(a + last, b), dtype=np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            k = i - self.zeros[level] if bit else i
            before = self.ones[level] if bit else np.minimum(np.arange(self.frames + 1) * FRAME, self.n) - self.ones[level]
            out = np.zeros(len(i), np.int64)
            for frame, rows in _by_frame(np.searchsorted(before, k, side="right") - 1):
                bits = np.unpackbits(self._frame(level, frame), bitorder="little")
                out[rows] = frame * FRAME + np.flatnonzero(bits == bit)[k[rows] - before[frame]]
            i = out
        return i

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a value."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        return int(self.find(value, k, k + 1)[0])

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            y, one = np.empty(self.n, kind), kind(1 << (self.bits - 1 - level))
            for k, ones in enumerate(self.ones[level, : self.frames].tolist()):
                out = y[k * FRAME : (k + 1) * FRAME]
                bit = np.unpackbits(self._open(level * self.frames + k), count=len(out), bitorder="little").view(bool)
                at, high, low = np.flatnonzero(bit), self.zeros[level] + ones, k * FRAME - ones
                out[np.flatnonzero(~bit)] = x[low : low + len(out) - len(at)]
                out[at] = x[high : high + len(at)] | one
            x = y
        return x


def _by_frame(frames: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each frame and the rows that lie in it."""
    order = np.argsort(frames, kind="stable")
    each, first = np.unique(frames[order], return_index=True)
    for k, rows in zip(each.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ():
        yield k, rows


def dump_shard(ids: np.ndarray, lengths: list[int], bits: int) -> bytes:
    sizes = zstandard.ZstdCompressor(level=1).compress(np.array(lengths, "<u8").tobytes())
    return MAGIC + struct.pack("<QQ", len(lengths), len(sizes)) + sizes + WaveletMatrix.build(ids, bits).dump()


def load_shard(data: bytes) -> tuple[np.ndarray, WaveletMatrix]:
    """The documents' lengths, and the ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard")
    n, size = struct.unpack_from("<QQ", data, 4)
    raw = zstandard.ZstdDecompressor().decompress(data[20 : 20 + size]) if n else b""
    return np.frombuffer(raw, "<u8", n).astype(np.int64), WaveletMatrix.load(data[20 + size :])


def _writer(path: str, end: int, shard_tokens: int, id_type: pa.DataType):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        bits = max(int(enc.size - 1).bit_length(), int(end).bit_length())
        last = np.array([end], "<u4").tobytes()
        kind = np.uint16 if bits <= 16 else np.uint32
        ids, lengths, docs, held = [], [], [], 0

        def flush():
            payload = dump_shard(np.frombuffer(b"".join(ids), "<u4").astype(kind), lengths, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([docs], pa.list_(id_type)), pa.array([payload], pa.binary())],
                ["part", "seq", "n_tokens", "docs", "payload"],
            )

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                ids += (data, last)
                lengths.append(len(data) // 4 + 1)
                docs.append(doc)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield flush()
                    ids, lengths, docs, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield flush()

    return write


def write_shards(docs: DataFrame, out: str, tokenizer: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode documents, append the end id to each, and write shards in ascending id order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    tie = F.xxhash64("text")  # splits the rows of an id that many rows share
    placed = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    write = _writer(tokenizer or default_path("byte_bpe_50k.json"), end, shard_tokens, pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string())
    shards = placed.mapInArrow(write, f"part int, seq int, n_tokens bigint, docs array<{kind}>, payload binary")
    shards.write.option("compression", "uncompressed").parquet(out)


def _reader(with_ids: bool):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("docs").type.value_type
            for row in range(batch.num_rows):
                part, seq = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                docs = batch.column(2)[row].values
                lengths, matrix = load_shard(batch.column(3)[row].as_py())
                ids, ends = matrix.decode(), np.cumsum(lengths)
                for a in range(0, len(lengths), 500):
                    b = min(a + 500, len(lengths))
                    first = int(ends[a] - lengths[a])
                    raw = memoryview(ids[first : int(ends[b - 1])].astype("<u4")).cast("B")
                    cuts = ((np.concatenate([[first], ends[a:b]]) - first) * 4).astype(np.int64)
                    sums = [zlib.crc32(raw[x:y]) for x, y in pairwise(cuts.tolist())]
                    names = ["part", "seq", "id", "at", "n_tokens", "ids_crc32"]
                    columns = [pa.array([part] * (b - a), pa.int32()), pa.array([seq] * (b - a), pa.int32()), docs[a:b].cast(kind), pa.array(ends[a:b] - lengths[a:b], pa.int64())]
                    columns += [pa.array(lengths[a:b], pa.int64()), pa.array(sums, pa.int64())]
                    if with_ids:
                        names.append("ids")
                        columns.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).cast(pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return shards


def _starts(shards: DataFrame) -> DataFrame:
    """The number of ids before each shard."""
    sizes = shards.select("part", "seq", "n_tokens")

    def before(window, count):
        return F.coalesce(F.sum(count).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # The window over all rows sees one row for each written partition, not each shard.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before(Window.orderBy("part"), "n").alias("base"))
    inside = sizes.select("part", "seq", before(Window.partitionBy("part").orderBy("seq"), "n_tokens").alias("inside"))
    return inside.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("shard_start"))


def read_shards(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """The documents (part, seq, id, at, n_tokens, ids_crc32, and ids as binary if wanted) and the
    number of ids before each shard (part, seq, shard_start). A caller joins them after dropping what
    it doesn't need, so that ids need not be shuffled."""
    shards = spark.read.parquet(path)
    kind = shards.schema["docs"].dataType.elementType.simpleString()
    schema = f"part int, seq int, id {kind}, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    docs = shards.select("part", "seq", "docs", "payload").mapInArrow(_reader(with_ids), schema)
    return docs.withColumnRenamed("id", id_col), _starts(shards)


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """How often each of some ids occurs in a folder of shards (token, n): two ranks a plane and shard,
    without decoding. Repeated tokens count once; ids that no shard holds have 0, in an empty folder too."""
    wanted = sorted(set(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                _, matrix = load_shard(payload.as_py())
                found = [(t, n) for t in wanted if (n := matrix.count(t))]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["token", "n"])

    each = spark.read.parquet(path).select("payload").mapInArrow(count, "token bigint, n bigint")
    asked = spark.createDataFrame([(t,) for t in wanted], "token bigint")
    return asked.join(each.groupBy("token").agg(F.sum("n").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def occurrences(spark: SparkSession, path: str, token: int, id_col: str = "doc_id") -> DataFrame:
    """Every occurrence of an id in a folder of shards: document, its place in the shard (part, seq,
    at), and the occurrence's place in the document. Only frames that hold occurrences are opened."""
    shards = spark.read.parquet(path)
    kind = shards.schema["docs"].dataType.elementType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, matrix = load_shard(batch.column(3)[row].as_py())
                ends, n = np.cumsum(lengths), matrix.count(token)
                for a in range(0, n, 50_000):
                    places = matrix.find(token, a, min(a + 50_000, n))
                    doc = np.searchsorted(ends, places, side="right")
                    at = ends[doc] - lengths[doc]
                    same = [pa.array(np.full(len(doc), batch.column(c)[row].as_py()), pa.int32()) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, batch.column(2)[row].values.take(pa.array(doc)), pa.array(at), pa.array(places - at)], ["part", "seq", "id", "at", "place"])

    found = shards.select("part", "seq", "docs", "payload").mapInArrow(find, f"part int, seq int, id {kind}, at bigint, place bigint")
    return found.withColumnRenamed("id", id_col)


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The ids at places (a column `place`, from 0 over the whole folder): place, token.

    Places are made distinct, meet their shard by ranges of RANGE ids and go to it in one group, which
    a shard's ids bound. Null places and places outside have no row.
    """
    shards = spark.read.parquet(path)
    size = F.lit(RANGE)
    starts = _starts(shards).join(shards.select("part", "seq", "n_tokens"), ["part", "seq"]).withColumn("end", F.col("shard_start") + F.col("n_tokens"))
    ranges = starts.withColumn("range", F.explode(F.sequence(F.floor(F.col("shard_start") / size), F.floor((F.col("end") - 1) / size))))
    asked = places.select(F.col("place").cast("bigint").alias("place")).where("place >= 0").distinct().withColumn("range", F.floor(F.col("place") / size))
    inside = asked.join(ranges, "range").where("place >= shard_start AND place < end").select(F.col("part").alias("p"), F.col("seq").alias("s"), "place", (F.col("place") - F.col("shard_start")).alias("i"))
    wanted = inside.select("p", "s").distinct()
    images = spark.read.parquet(path).select("part", "seq", "payload").join(wanted, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")), "left_semi")

    def access(image: pa.Table, rows: pa.Table) -> pa.Table:
        _, matrix = load_shard(image.column("payload")[0].as_py())
        return pa.table({"place": rows.column("place"), "token": pa.array(matrix.take(rows.column("i").to_numpy()), pa.int64())})

    return images.groupBy("part", "seq").cogroup(inside.groupBy("p", "s")).applyInArrow(access, "place bigint, token bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "token-shards")
    write_shards(read(spark, sf_dir, "documents"), out)
    docs, starts = read_shards(spark, out, with_ids=False)
    start = (F.col("shard_start") + F.col("at")).alias("start")
    return docs.join(starts, ["part", "seq"]).select("doc_id", start, "n_tokens", "ids_crc32")


QUERIES = {"op5_token_shards": query}
ORACLES: dict[str, str] = {}
