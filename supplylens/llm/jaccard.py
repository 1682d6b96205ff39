"""N-gram Jaccard join by grouped prefixes.

1. A document's set is its distinct word shingles, stored once as 48-bit hashes. Documents with equal
   sets form a class; only classes go on.
2. Members are ordered by how many documents hold them, the rarest first, which is counted over all
   documents: members are dealt to buckets by their hashes, so a bucket's size doesn't grow with the
   data. Members that a 64th of all documents hold come last and are known everywhere (there are at
   most 64 times a document's members), so that no bucket is hot.
3. A set's prefix is its rarest members, as many as a set that is similar enough cannot all lack. Only
   members that several documents hold can meet another set; the others need but be counted.
4. Classes with the same size and prefix form one group. Groups meet on the members of their
   prefixes; pairs are filtered by size and by what is left after the places of the meeting.
5. Pairs of groups expand to their classes, which are decided by their whole sets.

The links' components are wanted, not all links: a class is first compared with some leaders, drawn
from the classes that it meets in its band of sizes, and what that joins need not be compared again.
All pairs that still lie in different components are then compared, so no link between components is
lost. A family of near copies thus takes about as many comparisons as it has members.

Cases: texts that are null, empty or without words have empty sets and are linked with nothing;
repeated rows have the same class; rows with null ids are members but name no component (it stays
null if all are null); other columns are ignored; texts are read whole; an empty table gives no
rows. Classes and groups are told apart by 64-bit hashes: among n classes about n^2 / 2^65 pairs share
one by chance. Two members of one document share a 48-bit hash with probability 2^-48 each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.common import bounded_batches, durable, forget, read, release, split_by_keys

WORDS, PERCENT = 3, 90
#: Entries of the bitmap that spares shuffling sets that aren't compared.
MARKED = 1 << 20
KEPT_WORDS = 400_000
#: Bits of a member, members of a bucket, and the share of documents from which on a member is hot.
BITS, BUCKET, HOT = 48, 1 << 18, 64
#: Leaders that a class is compared with in a round; rounds go on as long as they join much.
LEADERS, ROUNDS = 16, 6


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


_hashes = _Hashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, ascending. With fewer words, the whole sequence is one."""
    found = (text or "").encode().lower().split()  # ASCII letters and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    x = h[:n].copy()
    for k in range(1, min(words, len(h))):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.unique(x)


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _packed(x: np.ndarray) -> bytes:
    """The upper 48 bits of ascending hashes, six bytes each."""
    return np.ascontiguousarray((x >> np.uint64(64 - BITS)).view(np.uint8).reshape(-1, 8)[:, : BITS // 8]).tobytes()


def _unpacked(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : BITS // 8] = raw
    return out.reshape(-1).view(np.uint64)


def _set_maker(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(batches):
            sizes, classes, sets = [], [], []
            for text in batch.column(1).to_pylist():
                x = shingles(text, words)
                sizes.append(len(x))
                classes.append(_digest(x.tobytes()) if len(x) else None)
                sets.append(_packed(x))
            chunk, at = pa.array([first + k] * len(sizes), pa.int64()), pa.array(range(len(sizes)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), chunk, at, pa.array(sets, pa.binary())], ["id", "th", "n", "c", "chunk", "at", "x"]
            )

    return run


def _runs(batch: pa.RecordBatch):
    """(chunk, its rows' slices) of a stored batch."""
    chunks = batch.column(0).to_numpy()
    ends = [*(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)] if len(chunks) else []
    start = 0
    for end in ends:
        yield int(chunks[start]), batch.slice(start, end - start)
        start = end


def _members(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All members of the rows' sets, and the number of the row that each belongs to."""
    data = rows.column(2).to_pylist()
    own = np.repeat(rows.column(1).to_numpy().astype(np.uint16), [len(x) // (BITS // 8) for x in data])
    return _unpacked(b"".join(data)), own


def _held_often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that at least one in 2 * HOT rows of a chunk holds, and eight: fewer are no sign of a hot one."""
    for batch in batches:
        for _, rows in _runs(batch):
            members, counts = np.unique(_members(rows)[0], return_counts=True)
            often = counts >= max(8, rows.num_rows / (2 * HOT))
            yield pa.RecordBatch.from_arrays([pa.array(members[often].astype(np.int64)), pa.array(counts[often].astype(np.int64))], ["token", "k"])


ROWS = [(name, pa.binary()) for name in ("tokens", "owners", "rarity", "ats", "sizes", "classes")]
ROWS_DDL = ", ".join(f"{name} binary" for name, _ in ROWS)


def _dealer(bits: int, hot: np.ndarray):
    """Members of a chunk's sets by bucket, each with the row that holds it; what isn't asked for goes by (-1 - chunk).

    A member's bucket is its first bits; 32 bits that follow tell it apart inside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in _runs(batch):
                tokens, own = _members(rows)
                known = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens if len(hot) else np.zeros(len(tokens), bool)
                asked, whose = tokens[~known], own[~known]
                bucket = (asked >> np.uint64(BITS - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
                order = np.argsort(bucket, kind="stable")
                low = (asked << np.uint64(64 - BITS + bits) >> np.uint64(32)).astype(np.uint32)[order]
                found, sizes = np.unique(bucket, return_counts=True)
                ends = np.cumsum(sizes)
                parts = [
                    [x[end - size : end].tobytes() for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)]
                    for x in (low, whose[order])
                ]
                # The row's own part: hot members, numbers, sizes and classes.
                columns = [tokens[known], own[known], rows.column(1).to_numpy().astype(np.uint16), rows.column(3).to_numpy(), rows.column(4).fill_null(0).to_numpy()]
                parts = [[*part, x.tobytes()] for part, x in zip(parts, columns[:2], strict=True)]
                empty = [None] * len(found)
                parts += [[*empty, None], *([*empty, x.tobytes()] for x in columns[2:])]
                arrays = [pa.array([*found.tolist(), -1 - chunk], pa.int64()), pa.array([chunk] * (len(found) + 1), pa.int64()), *(pa.array(p, pa.binary()) for p in parts)]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "chunk", *(name for name, _ in ROWS)])

    return run


def _counter(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each chunk the members of a bucket that several documents hold, with their rarity."""
    bucket = key[0].as_py()
    if bucket < 0:
        return table
    tokens = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint32)
    owners = np.frombuffer(b"".join(table["owners"].to_pylist()), np.uint16)
    ends = np.cumsum([len(x) // 4 for x in table["tokens"].to_pylist()]).tolist()
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    rarity = np.minimum(254, 8 * np.log2(counts)).astype(np.uint8)[inverse]
    shared = counts[inverse] > 1
    chunks, parts, start = [], [], 0
    for chunk, end in zip(table["chunk"].to_pylist(), ends, strict=True):
        here = shared[start:end]
        if here.any():
            chunks.append(chunk)
            parts.append([x[start:end][here].tobytes() for x in (tokens, owners, rarity)])
        start = end
    empty = [pa.array([None] * len(chunks), pa.binary())] * (len(ROWS) - 3)
    found = [pa.array(x, pa.binary()) for x in zip(*parts, strict=True)] if parts else [pa.array([], pa.binary())] * 3
    return pa.table([pa.array([bucket] * len(chunks), pa.int64()), pa.array(chunks, pa.int64()), *found, *empty], names=["bucket", "chunk", *(name for name, _ in ROWS)])


PREFIX = [("c", pa.int64()), ("n", pa.int64()), ("g", pa.int64()), ("chunk", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("tokens", pa.list_(pa.int64()))]


def _prefixer(percent: int, bits: int):
    """For each class of a chunk whose prefix has members that several documents hold: these, and the first one's place."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk, rows = key[0].as_py(), table.to_pylist()
        sets = {}
        keys, owners = [], []
        for r in rows:
            own = np.frombuffer(r["owners"], np.uint16)
            if r["ats"] is None:
                whole = (np.uint64(r["bucket"] << 32) | np.frombuffer(r["tokens"], np.uint32)) >> np.uint64(max(0, bits + 32 - BITS))
                tokens = np.frombuffer(r["rarity"], np.uint8).astype(np.uint64) << np.uint64(BITS) | whole
            else:
                tokens = np.frombuffer(r["tokens"], np.uint64) | np.uint64(255 << BITS)
                for at, n, c in zip(*(np.frombuffer(r[k], t).tolist() for k, t in (("ats", np.uint16), ("sizes", np.int64), ("classes", np.int64))), strict=True):
                    sets[at] = n, c
            keys.append(tokens)
            owners.append(own)
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((keys, owners))
        keys, owners = keys[order].view(np.int64), owners[order]
        out, seen = [], set()
        for at, start, end in zip(*_spans(owners), strict=True):
            n, c = sets[at]
            alone = n - (end - start)  # members that no other document holds come first
            wanted = n - (percent * n + 99) // 100 + 1 - alone
            # Where even one member more or less is too much, only equal sets are similar.
            if wanted <= 0 or 100 * n < percent * (n + 1) or c in seen:
                continue
            seen.add(c)
            tokens = keys[start : min(end, start + wanted)]
            group = c if alone else _digest(tokens.tobytes() + n.to_bytes(8, "little"))
            out.append((c, n, group, chunk, at, alone, tokens))
        columns = zip(*out, strict=True) if out else [[]] * len(PREFIX)
        return pa.table([pa.array(list(x), t) for x, (_, t) in zip(columns, PREFIX, strict=True)], schema=pa.schema(PREFIX))

    return run


def _spans(owners: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Each value of a sorted array, with its first place and the one after its last."""
    values, starts = np.unique(owners, return_index=True)
    return values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(owners)]


def _comparer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = _unpacked(a.as_buffer()), _unpacked(b.as_buffer())
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[at] == a).sum())
                if 100 * common >= percent * (len(a) + len(b) - common):
                    keep.append(k)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    return run


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(u, v): each node of the links (a, b) that isn't the smallest of its component, and the smallest; a stored frame.

    Large-star and small-star steps in turn; every step's edges are stored, so no lineage grows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = mark = None
    for turn in range(rounds):
        edges = durable(edges, f"edges{turn}")
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if before is not None:
            forget(before)
        if state == mark or not state[0]:
            return edges
        before, mark = edges, state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
    raise RuntimeError("components did not settle")


class Join:
    """The state of one join: documents, their sets and classes, and the postings of the groups.

    docs should be a stored table: its rows are numbered as they are read.
    """

    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        bounded_batches(self.spark)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        found = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
        self.sets = durable(found.mapInArrow(_set_maker(words), "id bigint, th bigint, n bigint, c bigint, chunk bigint, at int, x binary"), "sets")
        self.rows = durable(self.sets.select("id", "th", "n", "c"), "rows")
        prefixes = durable(self.prefixes(), "prefixes")
        release(self.spark)
        # Copies meet as one row from each chunk.
        first = F.min_by(F.struct(*(name for name, _ in PREFIX[1:])), F.struct("chunk", "at"))
        stored = durable(prefixes.groupBy("c").agg(first.alias("p")).select("c", "p.*"), "classes")
        self.classes = stored.drop("tokens", "first")
        # A group of several classes is posted by its smallest.
        several = stored.groupBy("g").agg(F.min("c").alias("least"), F.count("*").alias("held")).where("held > 1")
        self.several = durable(several, "several")
        posted = stored.join(self.several, "g", "left").where("least is null or c = least")
        postings = posted.select("c", "n", F.coalesce("held", F.lit(1)).alias("held"), F.posexplode("tokens").alias("pos", "token"), "first")
        postings = postings.select("token", "c", "n", (F.col("first") + F.col("pos")).alias("pos"), F.col("first").alias("own"), "held")
        met = postings.groupBy("token").agg(F.sum("held").alias("met")).where("met > 1").select("token")
        self.postings = durable(postings.drop("held").join(met, "token", "left_semi"), "postings")
        self.stored = [prefixes, stored, self.several, self.postings]

    def prefixes(self) -> DataFrame:
        sized = self.rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.count(F.when(F.col("n") > 0, 1)).alias("sets")).first()
        bits = max(0, min(32, math.ceil(math.log2(max(1, sized["members"] / BUCKET)))))
        chunks = self.sets.where("n > 0").select("chunk", "at", "x", "n", "c")
        # A chunk has few rows, so a member can look frequent there by chance; the sum over all decides. One that
        # is missed only makes its bucket larger.
        often = chunks.mapInArrow(_held_often, "token bigint, k bigint").groupBy("token").agg(F.sum("k").alias("k"))
        hot = often.where(F.col("k") > max(HOT, sized["sets"] / HOT)).select("token").toArrow()  # at most HOT times a set's members
        hot = np.sort(hot["token"].to_numpy().astype(np.uint64))
        asked = chunks.mapInArrow(_dealer(bits, hot), f"bucket bigint, chunk bigint, {ROWS_DDL}")
        answers = asked.groupBy("bucket").applyInArrow(_counter, f"bucket bigint, chunk bigint, {ROWS_DDL}")
        return answers.groupBy("chunk").applyInArrow(_prefixer(self.percent, bits), "c bigint, n bigint, g bigint, chunk bigint, at int, first int, tokens array<bigint>")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are similar enough; a stored frame."""
        pairs = durable(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
        wanted = durable(wanted.join(self.classes, "c").select("c", "chunk", "at"), "wanted")
        mark = F.pmod(F.xxhash64("chunk", "at"), F.lit(MARKED)).alias("mark")
        # At most MARKED distinct numbers; the exact join follows, which leaves one row of each class.
        marks = F.broadcast(wanted.select(mark).distinct())
        near = self.sets.select("chunk", "at", "x").withColumn("mark", mark).join(marks, "mark", "left_semi")
        sets = durable(near.join(wanted, ["chunk", "at"]).select("c", "x"), "compared")
        both = pairs.join(sets.select(F.col("c").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("c").alias("b"), F.col("x").alias("xb")), "b")
        links = durable(both.select("a", "b", "xa", "xb").mapInArrow(_comparer(self.percent), "a bigint, b bigint"), "links")
        forget(pairs, wanted, sets)
        return links

    def need(self, n1: Column, n2: Column) -> Column:
        """The members that two similar sets of these sizes share at least."""
        return F.ceil(F.lit(self.percent) * (n1 + n2) / (100 + self.percent))

    def fits(self, n1: Column, n2: Column) -> Column:
        return 100 * F.least(n1, n2) >= self.percent * F.greatest(n1, n2)

    def close(self, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
        """Whether sets of these sizes that meet at these places of their prefixes can be similar enough."""
        return self.fits(n1, n2) & (F.least(n1 - p1, n2 - p2) >= self.need(n1, n2))

    def rooted(self, postings: DataFrame, label: DataFrame | None) -> DataFrame:
        """Postings with their components, of members that several components hold."""
        posts = postings.withColumn("root", F.col("c")) if label is None else postings.join(label, "c", "left").withColumn("root", F.coalesce("root", "c"))
        ends = posts.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
        return posts.join(ends, "token", "left_semi")

    def leaders(self, turn: int, label: DataFrame | None) -> DataFrame:
        """For each posted class, those leaders of its band of sizes that it meets most often.

        In every other round leaders are those with few members of their own: what others were copied
        from is nearer to all copies than they are to each other.
        """
        own = F.col("own") if turn % 2 == 0 else F.lit(0).alias("own")
        band = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(self.percent / 100)) + F.lit(turn // 2 % 2 * 0.5))
        draw = F.xxhash64("c", F.lit(turn))
        posts = self.rooted(self.postings, label).withColumns({"band": band, "draw": draw})
        led = posts.groupBy("token", "band", F.pmod("draw", F.lit(LEADERS)).alias("slot")).agg(F.min(F.struct(own, "draw", "c", "root", "n", "pos")).alias("lead"))
        met = posts.join(led.select("token", "band", "lead"), ["token", "band"]).where(F.col("root") != F.col("lead.root"))
        met = met.where(self.close(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
        met = met.groupBy("c", F.col("lead.c").alias("lead")).agg(F.count("*").alias("k"))
        best = F.slice(F.sort_array(F.collect_list(F.struct("k", "lead")), asc=False), 1, LEADERS)
        met = met.groupBy("c").agg(best.alias("best")).select("c", F.explode("best").alias("b")).select("c", "b.lead")
        return met.select(F.least("c", "lead").alias("a"), F.greatest("c", "lead").alias("b")).distinct()

    def remaining(self, label: DataFrame) -> DataFrame:
        """All pairs of classes in different components that pass the filters."""
        # Groups expand to their classes, whose components may differ.
        others = self.classes.join(self.several, "g").where("c <> least").select(F.col("least").alias("c"), F.col("c").alias("other"))
        postings = self.postings.drop("own")
        posts = postings.unionByName(postings.join(others, "c").select("token", F.col("other").alias("c"), "n", "pos"))
        posts = durable(self.rooted(posts, label), "mixed")
        self.stored.append(posts)
        # Components meet before their members do, so a component's own pairs are never made. The smaller
        # set of a pair meets the other in the first places of its prefix.
        left = F.col("n") - F.col("pos")
        held = posts.groupBy("token", "root").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(left).alias("left"), F.max(left - self.need(F.col("n"), F.col("n"))).alias("early"))
        x, y = held.alias("x"), held.alias("y")
        reach = (100 * F.col("x.most") >= self.percent * F.col("y.least")) & (100 * F.col("y.most") >= self.percent * F.col("x.least"))
        reach = reach & (F.greatest("x.early", "y.early") >= 0) & (F.least("x.left", "y.left") >= self.need(F.col("x.least"), F.col("y.least")))
        meet = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & reach)
        meet = meet.select(F.col("x.token").alias("token"), F.col("x.root").alias("r1"), F.col("y.root").alias("r2"))
        one = posts.select("token", F.col("root").alias("r1"), F.col("c").alias("c1"), F.col("n").alias("n1"), F.col("pos").alias("p1"))
        two = posts.select("token", F.col("root").alias("r2"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("pos").alias("p2"))
        close = self.close(F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2"))
        return meet.join(one, ["token", "r1"]).join(two, ["token", "r2"]).where(close).select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct()

    def run(self) -> DataFrame:
        """(c, root) for classes that aren't the smallest of their component; a stored frame. The sets are given up."""
        # Classes of one group first meet the group's smallest.
        inside = self.classes.join(self.several, "g").where("c <> least").select(F.least("c", "least").alias("a"), F.greatest("c", "least").alias("b"))
        links, label = None, None
        for turn in range(ROUNDS):
            pairs = self.leaders(turn, label)
            found = self.verify(pairs.unionByName(inside).distinct() if turn == 0 else pairs)
            new = found.count()
            if new:
                links = found if links is None else label.select(F.col("c").alias("a"), F.col("root").alias("b")).unionByName(found)
                stored = components(links)
                if label is not None:
                    forget(self.labelled)
                self.labelled, label = stored, stored.select(F.col("u").alias("c"), F.col("v").alias("root"))
            forget(found)
            first = new if turn == 0 else first
            if new * 10 <= first:  # the rest is compared without leaders
                break
        if label is None:
            self.labelled = durable(self.spark.createDataFrame([], "u bigint, v bigint"), "edges")
            label = self.labelled.select(F.col("u").alias("c"), F.col("v").alias("root"))
        found = self.verify(self.remaining(label))
        stored = components(label.select(F.col("c").alias("a"), F.col("root").alias("b")).unionByName(found))
        forget(self.labelled, found, self.sets, *self.stored)
        release(self.spark)
        return stored.select(F.col("u").alias("c"), F.col("v").alias("root"))


def _join(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, th, n, c), and (c, id, th, root) of every class."""
    join = Join(docs, words, percent, id_col, text_col)
    label = join.run()
    first = F.min_by(F.struct("id", "th"), F.struct(F.col("id").isNull(), "id", "th"))
    classes = join.rows.where("c is not null").groupBy("c").agg(first.alias("d")).select("c", "d.id", "d.th")
    return join.rows, classes.join(label, "c", "left").withColumn("root", F.coalesce("root", "c"))


def similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (a hash of the text), n_shingles and component_id of every row."""
    rows, named = _join(docs, words, percent, id_col, text_col)
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = named.join(least, "root").select("c", "component_id")
    full = rows.where("c is not null").select("id", "th", "n", "c").join(by_class, "c").select("id", "th", "n", "component_id")
    empty = rows.where("c is null").select("id", "th", "n", F.col("id").alias("component_id"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), "th", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component as it is, that of the smallest id; rows without words all stay."""
    found, named = _join(docs, words, percent, id_col, text_col)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("th"))
    best = named.groupBy("root").agg(F.min_by(F.struct("c", "id", "th"), order).alias("best"))
    kept = named.join(best, "root").select("c", "best").alias("k")
    rows = found.where("c is not null").select("id", "th", "c").alias("r")
    other = ~(F.col("r.id").eqNullSafe(F.col("k.best.id")) & (F.col("r.th") == F.col("k.best.th")))
    joined = rows.join(kept, F.col("r.c") == F.col("k.c"))
    dropped = durable(joined.where(other).select("r.id", "r.th").distinct(), "dropped")
    left = split_by_keys(docs, dropped, id_col, text_col)[1]
    # The same row twice is a group as well.
    twice = durable(joined.where(~other).groupBy("r.id", "r.th").agg(F.count("*").alias("k")).where("k > 1").select("id", "th"), "twice")
    again, single = split_by_keys(left, twice, id_col, text_col)
    return single.unionByName(again.dropDuplicates([id_col, text_col]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read(spark, sf_dir, "documents")).drop("th")


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT DISTINCT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a, least(a, min(b)) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.m, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""

QUERIES = {"op9_grouped_prefix_join": query}
ORACLES = {"op9_grouped_prefix_join": SQL}
