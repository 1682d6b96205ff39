"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, white space as one space) and hashed. Within a host (the
document's source) a line is boilerplate when it stands in more than `limit` documents of different
texts; only documents of equal text count once. Boilerplate lines are removed; a document that keeps
less than `least_share` of its words is depleted and rejected, as are documents that fail the base
rules.

Cases: a null text has no words and fails; a null source is a host of its own; rows with the same text
count once for a host's frequencies and get the same verdict each there; an empty table gives no rows;
other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.common import WORD_GAP, durable, let, read, shuffle_width

LIMIT, LEAST_SHARE = 10, 0.2
SYMBOLS = "#*$%&|<>"
WORD_GAP_SQL = "'" + WORD_GAP.replace("\\", "\\\\") + "'"
SPACES = " \t\n\x0b\x0c\r"


def _texts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.col(host_col).cast("string").alias("host"))


def _same_row() -> Column:
    """a and b: equal ids, texts and hosts."""
    return F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")) & F.col("a.host").eqNullSafe(F.col("b.host"))


def _bound(value: str, name: str, body: str) -> str:
    """SQL: body with a name for a value that is computed once. Columns in a chain of projections would
    be put into one another, lambdas included, as soon as a filter is pushed through them."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeats() -> str:
    """SQL over the words w and a text t: n_words, n_repeat_words and whether the base rules fail."""
    windows = "if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"
    sorted_ = "sort_array(transform(h, (x, i) -> struct(x, i)))"
    places = "sort_array(transform(filter(s, (e, k) -> get(s, k - 1).x <=> e.x or get(s, k + 1).x <=> e.x), e -> e.i))"
    covered = "aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0L, (a, x) -> a + x)"
    found = _bound(sorted_, "s", _bound(places, "p", covered))
    count = _bound(windows, "h", f"if(size(array_distinct(h)) = size(h), 0L, {found})")
    both = _bound(count, "r", "named_struct('n_words', cast(size(w) as bigint), 'n_repeat_words', r, 'failed', size(w) < 50 or 100 * r > 50 * size(w))")
    return _bound(f"filter(split(t, {WORD_GAP_SQL}), x -> x <> '')", "w", both)


def base_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The base counts of each row, with `th`, a hash of its text."""
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return _texts(docs, id_col, text_col, host_col).select(
        "doc_id",
        "host",
        F.xxhash64("t").alias("th"),
        F.expr(_repeats()).alias("m"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ).select("doc_id", "host", "th", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", F.col("m.failed").alias("base_failed"))


def _lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Each row's normalised lines; those without a word are empty."""
    normal = F.transform(F.split("t", "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), WORD_GAP, " ")))
    return _texts(docs, id_col, text_col, host_col).select("doc_id", F.xxhash64("t").alias("th"), "host", normal.alias("lines"))


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT) -> DataFrame:
    """(host, line): hashes of the lines that stand in too many documents of a host."""
    hashes = F.array_distinct(F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.xxhash64(x)))
    rows = _lines(docs, id_col, text_col, host_col).select("host", "th", F.explode(hashes).alias("line"))
    # A line that most documents hold meets as one row for each text, then one for each task.
    return rows.distinct().groupBy("host", "line").agg(F.count("*").alias("texts")).where(F.col("texts") > limit).select("host", "line")


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT) -> DataFrame:
    """(doc_id, th, host, removed, n_words, places): words in boilerplate lines and in all, and which lines these
    are, for documents that have any."""
    salts = min(32, max(8, shuffle_width(docs.sparkSession) // 4))
    bad = boilerplate(docs, id_col, text_col, host_col, limit)
    bad = bad.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pieces = F.transform("lines", lambda x, i: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"), i.alias("pos"), x.alias("x")))
    pieces = F.transform(F.filter(pieces, lambda p: p["x"] != ""), lambda p: F.struct(p["line"].alias("line"), p["words"].alias("words"), p["pos"].alias("pos")))
    total = F.aggregate(pieces, F.lit(0), lambda a, p: a + p["words"])
    rows = _lines(docs, id_col, text_col, host_col).select("doc_id", "th", "host", total.alias("n_words"), F.pmod("th", F.lit(salts)).cast("int").alias("salt"), F.explode(pieces).alias("l"))
    rows = rows.select("doc_id", "th", "host", "n_words", "salt", "l.*").alias("a")
    same = F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.salt") == F.col("b.salt"))
    hit = rows.join(bad.alias("b"), same, "left_semi")
    # Rows repeated on a host have the same lines at the same places.
    once = hit.groupBy("doc_id", "th", "host", "pos").agg(F.max("words").alias("words"), F.max("n_words").alias("n_words"))
    return once.groupBy("doc_id", "th", "host").agg(F.sum("words").alias("removed"), F.max("n_words").alias("n_words"), F.collect_list("pos").alias("places"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT, least_share: float = LEAST_SHARE) -> DataFrame:
    """The base counts and the verdict of every row, with th, a hash of its text."""
    base = base_metrics(docs, id_col, text_col, host_col).alias("a")
    lost = removed_words(docs, id_col, text_col, host_col, limit).select("doc_id", "th", "host", "removed").alias("b")
    left = F.col("n_words") - F.coalesce(F.col("b.removed"), F.lit(0))
    kept = ~F.col("base_failed") & (left >= least_share * F.col("n_words"))
    return base.join(lost, _same_row(), "left").select(*(f"a.{c}" for c in base.columns if c != "host"), F.coalesce(F.col("b.removed"), F.lit(0)).cast("long").alias("n_boilerplate_words"), kept.alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", length_col: str | None = None, limit: int = LIMIT, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs that pass, their texts without boilerplate lines; length_col gets the new length.

    Documents with such lines are few as a rule: the planner broadcasts them if their stored size allows
    it and shuffles both sides if not.
    """
    lost = durable(removed_words(docs, id_col, text_col, host_col, limit), "lost").alias("b")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.col(host_col).cast("string").alias("host"))
    passed = rows.where(~F.expr(_repeats() + ".failed")).select("row", "doc_id", "t", "host", F.xxhash64("t").alias("th")).alias("a")
    left = F.col("b.n_words") - F.col("b.removed")
    joined = passed.join(lost, _same_row(), "left").where(F.col("b.th").isNull() | (left >= least_share * F.col("b.n_words")))
    lines = F.split("t", "\n")
    others = let(lines, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("places")), lambda i: F.get(x, i)))
    text = F.when(F.col("b.th").isNull(), F.col("row").getField(text_col)).otherwise(F.array_join(others, "\n"))
    whole = joined.select("row", text.alias("text"))
    own = {text_col: F.col("text")} | ({length_col: F.length("text").cast(docs.schema[length_col].dataType)} if length_col else {})
    return whole.select(*(own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("th")


SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
raw AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
lines AS (SELECT rid, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS x FROM raw
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
held AS (SELECT DISTINCT d.host, d.t, l.x FROM lines l JOIN d USING (rid)),
bad AS (SELECT host, x FROM held GROUP BY host, x HAVING count(*) > {LIMIT}),
lost AS (SELECT l.rid, sum(length(l.x) - length(replace(l.x, ' ', '')) + 1) AS n
         FROM lines l JOIN d USING (rid) JOIN bad b ON b.host IS NOT DISTINCT FROM d.host AND b.x = l.x GROUP BY l.rid),
m AS (SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(lost.n, 0) AS BIGINT) AS n_boilerplate_words
      FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_boilerplate_words,
  (NOT base_failed AND n_words - n_boilerplate_words >= {LEAST_SHARE} * n_words) AS kept FROM f
"""

QUERIES = {"op10_line_frequency": query}
ORACLES = {"op10_line_frequency": SQL}
