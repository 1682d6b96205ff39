"""Fill-in-middle transformation by a kernel over the UTF-8 buffers of whole Arrow batches.

A batch of texts is one buffer of bytes with offsets. Each byte has a class by a table of 256 entries;
a table over the classes of a byte and the one before says whether a unit begins at the byte (a code
point, a word with the white space before it, or a line). The running sum of these marks, reset at each
document, numbers the units, and one binary search over it finds the cuts of all rows together. The
pieces are then copied to their new places in one gather of bytes.

Cases: a null or empty text is empty and plain; a null id counts as empty text in the hash; texts that
hold one of the marks are plain, so that what was cut can be told from the output; repeated rows
come out as often, each by its id alone; texts of any length are cut whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.common import bounded_batches, read

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SPM = 90, 20  # h3 % 100 from here on: plain; h4 % 100 below: suffix first
SEED = 1

#: Classes of bytes.
LETTER, BLANK, LINE_END, INSIDE = range(4)


def byte_classes() -> np.ndarray:
    classes = np.full(256, LETTER, np.uint8)
    classes[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = BLANK
    classes[0x0A] = LINE_END
    classes[0x80:0xC0] = INSIDE
    return classes


def boundaries(unit: str) -> np.ndarray:
    """Whether a unit begins at a byte, by (class of the byte before, class of the byte)."""
    table = np.zeros((4, 4), bool)
    if unit == "char":
        table[:, [LETTER, BLANK, LINE_END]] = True
    elif unit == "word":  # white space goes with the word after it
        table[np.ix_([LETTER, INSIDE], [BLANK, LINE_END])] = True
    elif unit == "line":
        table[LINE_END, [LETTER, BLANK, LINE_END]] = True
    else:
        raise ValueError(f"unit {unit}")
    return table


CLASSES = byte_classes()


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch and where its rows begin and end in them; nulls are empty."""
    large = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if places else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def units(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many units begin before each byte, and before each row."""
    classes = CLASSES[raw]
    begins = np.empty(len(raw), bool)
    begins[1:] = table[classes[:-1], classes[1:]]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[starts] = True  # every text begins with a unit
    sums = np.concatenate([[0], np.cumsum(begins)])
    return sums, sums[offsets]


def cuts(sums: np.ndarray, before: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte at which unit `at` of each row begins; the row's end after its last unit."""
    return np.minimum(np.searchsorted(sums, before + at, side="right") - 1, ends)


def gather(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of pieces [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.uint8)
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return raw[np.arange(total) + shift]


def transform(texts: pa.Array, h: list[np.ndarray], whole: np.ndarray, unit: str = "char", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), plain: int = PLAIN, spm: int = SPM) -> dict[str, pa.Array]:
    """n, form, prefix, middle (in units) and output of each row; whole: rows that stay as they are."""
    raw, offsets = _buffers(texts)
    begin, end = offsets[:-1], offsets[1:]
    sums, counts = units(raw, offsets, boundaries(unit))
    before, n = counts[:-1], np.diff(counts)
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    first, second = np.minimum(a, b), np.maximum(a, b)
    kept = whole | (n == 0) | (h[2] % 100 >= plain)
    turned = ~kept & (h[3] % 100 < spm)
    one, two = cuts(sums, before, end, first), cuts(sums, before, end, second)
    # Marks stand behind the texts; a row is up to six pieces.
    tags = [np.frombuffer(m.encode(), np.uint8) for m in marks]
    data = np.concatenate([raw, *tags])
    p, s, m = (len(raw) + sum(map(len, tags[:k])) for k in range(3))
    lp, ls, lm = map(len, tags)
    rows = len(begin)
    starts, lengths = np.zeros((rows, 6), np.int64), np.zeros((rows, 6), np.int64)
    head, mid, tail = (begin, one - begin), (one, two - one), (two, end - two)

    def put(which: np.ndarray, parts: list) -> None:
        for k, (at, size) in enumerate(parts):
            starts[which, k] = at[which] if isinstance(at, np.ndarray) else at
            lengths[which, k] = size[which] if isinstance(size, np.ndarray) else size

    put(kept, [(begin, end - begin)])
    put(~kept & ~turned, [(p, lp), head, (s, ls), tail, (m, lm), mid])
    put(turned, [(s, ls), tail, (p, lp), head, (m, lm), mid])
    out = gather(data, starts.ravel(), lengths.ravel())
    places = np.concatenate([[0], np.cumsum(lengths.sum(axis=1))])
    output = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(out))
    form = np.where(kept, "plain", np.where(turned, "spm", "psm"))
    return {"n": pa.array(n.astype(np.int64)), "form": pa.array(form, pa.string()), "prefix": pa.array(first.astype(np.int64), mask=kept), "middle": pa.array((second - first).astype(np.int64), mask=kept), "output": output.cast(pa.string())}


def _runner(unit: str, marks: tuple[str, str, str], plain: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            whole = batch.column(6).to_numpy(zero_copy_only=False).astype(bool)
            got = transform(batch.column(1), h, whole, unit, marks, plain, spm)
            yield pa.RecordBatch.from_arrays([batch.column(0), *got.values()], ["id", *got])

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), plain: int = PLAIN, spm: int = SPM, seed: int = SEED
) -> DataFrame:
    """id, n, form, prefix, middle and output of each row. unit: char, word or line; plain: per cent of rows from
    which on a row stays as it is; spm: per cent of the others that begin with the suffix."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    held = F.lit(False)
    for m in marks:
        held = held | F.contains(text, F.lit(m))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest.alias("digest"), held.alias("whole"))
    parts = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = rows.select("id", "text", *parts, "whole")
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_runner(unit, marks, plain, spm), f"id {kind}, n long, form string, prefix long, middle long, output string")
    return found.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output and its form stand for; a mark must not begin inside another."""
    prefix, suffix, middle = map(F.lit, marks)
    psm, spm = F.split_part(F.substring(output, len(marks[0]) + 1, 2**31 - 1), suffix, F.lit(1)), F.split_part(output, prefix, F.lit(2))
    head = F.when(form == "psm", psm).otherwise(F.split_part(spm, middle, F.lit(1)))
    tail = F.when(form == "psm", F.split_part(F.split_part(output, suffix, F.lit(2)), middle, F.lit(1))).otherwise(F.split_part(F.substring(output, len(marks[1]) + 1, 2**31 - 1), prefix, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(head, F.split_part(output, middle, F.lit(2)), tail))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(read(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", F.col("prefix").alias("prefix_chars"), F.col("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


#: With every character as the second engine counts them: code points.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {PLAIN} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substring(t, 1, a) AS head, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS tail FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || head || '{SUFFIX}' || tail || '{MIDDLE}' || mid ELSE '{SUFFIX}' || tail || '{PREFIX}' || head || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

QUERIES = {"op11_fill_in_middle": query}
ORACLES = {"op11_fill_in_middle": SQL}
