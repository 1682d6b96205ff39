"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are the matches of four base patterns and of five looser ones. Three labelers vote on
each: the form (checks on the match itself), a gazetteer (known domains, prefixes, codes, names)
and the context (the words before). Expectation-maximisation over the counts of vote patterns, a
table of fixed size, estimates how reliable each labeler is for each kind. Its posteriors are the
labels from which the final span classifier, a naive Bayes over votes and shape features, is
trained; the classifier is a SQL expression. Base spans are always reported; looser spans when the
classifier accepts them and no base span covers them.

Cases: a null or empty text has no spans; repeated and null ids are rows of their own; texts are
scanned whole, every pattern without nested backtracking; an empty table trains nothing and gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.common import durable, read

BASE = ("email", "ip", "card", "phone")
ADDED = ("hidden_email", "local_phone", "ssn", "iban", "person")
KINDS = BASE + ADDED

# Patterns. Where a base pattern could start anew inside a run it has failed on, the
# start is held to the run's beginning or the last match's end, which gives the same matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "hidden_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
}
# Cheap signs without which a pattern cannot match.
SIGNS = {
    "email": "contains(t, '@')",
    "ip": "digits and contains(t, '.')",
    "card": "digits",
    "phone": "digits and contains(t, '+')",
    "hidden_email": "contains(t, '(at)') or contains(t, '[at]')",
    "local_phone": "digits",
    "ssn": "digits and contains(t, '-')",
    "iban": "digits",
    "person": "titled",
}
# The gazetteer, as patterns that a known match meets.
KNOWN = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|it|nl|eu|ch|at|be|ca|us)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|2[2-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|33|34|39|41|43|44|49|31|32|351|353|45|46|47|48|52|55|61|81|86|91)(?![0-9]{13})",
    "hidden_email": r"(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|it|nl|eu)$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "person": r"(?i)\x20(?:james|mary|john|anna|maria|peter|paul|marie|jean|pierre|hans|klaus|jose|juan|carmen|michael|david|sarah|laura|thomas)\b",
}
# Words before a match that speak for it, and words that speak against any.
SPEAKS_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|from|adresse|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|cell|telefon|téléphone|teléfono|whatsapp)\b",
    "hidden_email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    "local_phone": r"(?i)\b(?:tel|phone|call|mobile|fax|cell|telefon)\b",
    "ssn": r"(?i)\b(?:ssn|social security|tax id)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "person": r"(?i)\b(?:dear|contact|by|with|name|signed|liebe|cher|estimado)\b",
}
SPEAKS_AGAINST = r"(?i)\b(?:version|isbn|issn|doi|order|invoice|section|figure|table|part|release|model|serial)\b[^\n]{0,12}$"
CHUNK = 256


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return f"{m} rlike '^{part}(?:[.]{part}){{3}}$'"
    if kind == "phone":
        return f"length({digits}) between 10 and 15"
    if kind == "card":
        value = "cast(substring(d, -i, 1) as int)"
        luhn = f"aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 1, {value}, {value} * 2 - if({value} > 4, 9, 0)))"
        return f"element_at(transform(array({digits}), d -> if(length(d) between 14 and 19, {luhn} % 10 = 0, false)), 1)"
    return "true"


def _matches(kind: str) -> str:
    """SQL for the candidates of a kind in t, with places in code points.

    Places are running sums of the lengths of matches and of what lies between, taken over chunks, so
    that a text with very many matches costs little more than a step for each.
    """
    r, k = _literal(PATTERNS[kind]), KINDS.index(kind)
    chunk = f"transform(sequence(0, size(l) div {CHUNK}), c -> aggregate(slice(l, c * {CHUNK} + 1, {CHUNK}), 0, (a, x) -> a + x))"
    base = "transform(sequence(0, size(h) - 1), c -> aggregate(slice(h, 1, c), 0, (a, x) -> a + x))"
    start = f"b[i div {CHUNK}] + aggregate(slice(l, (i div {CHUNK}) * {CHUNK} + 1, i % {CHUNK}), 0, (a, x) -> a + x) + length(z.p[i])"
    one = f"named_struct('k', {k}, 'start', cast({start} as bigint), 'm', m, 'ok', {_valid(kind, 'm')}, 'before', right(z.p[i], 48))"
    # Each transform over a one-element array binds a name to a value that is computed once.
    inner = f"transform(z.m, (m, i) -> {one})"
    with_base = f"element_at(transform(array({base}), b -> {inner}), 1)"
    with_chunks = f"element_at(transform(array({chunk}), h -> {with_base}), 1)"
    with_lengths = f"element_at(transform(array(transform(z.m, (m, i) -> length(z.p[i]) + length(m))), l -> {with_chunks}), 1)"
    found = f"element_at(transform(array(named_struct('m', regexp_extract_all(t, {r}, 0), 'p', split(t, {r}))), z -> {with_lengths}), 1)"
    none = "cast(array() as array<struct<k:int,start:bigint,m:string,ok:boolean,before:string>>)"
    return f"if({SIGNS[kind]}, {found}, {none})"


def _searched(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"), *(carry or []))
    titled = " or ".join(f"contains(t, '{x}')" for x in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor"))
    rows = rows.withColumns({"digits": F.expr("t rlike '[0-9]'"), "titled": F.expr(titled)})
    return rows.withColumn("found", F.expr(f"concat({', '.join(map(_matches, KINDS))})")).drop("digits", "titled")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, found): every candidate of every row; th is a hash of the text."""
    return _searched(docs, id_col, text_col).drop("t")


def _by_kind(k: str, cases: dict[str, str], otherwise: str) -> str:
    return f"case {k} {' '.join(f'when {KINDS.index(kind)} then {sql}' for kind, sql in cases.items())} else {otherwise} end"


def featured(s: str) -> dict[str, str]:
    """SQL for the votes (1, 0, -1) and shape features of a candidate s."""
    form = f"if({s}.ok, if({s}.k < {len(BASE)}, 1, 0), -1)"
    known = _by_kind(f"{s}.k", {k: f"if({s}.m rlike {_literal(r)}, 1, {0 if k == 'person' else -1})" for k, r in KNOWN.items()}, "0")
    speaks = _by_kind(f"{s}.k", {k: f"{s}.before rlike {_literal(r)}" for k, r in SPEAKS_FOR.items()}, "false")
    context = f"case when {s}.before rlike {_literal(SPEAKS_AGAINST)} then -1 when {speaks} then 1 else 0 end"
    digits = f"length(regexp_replace({s}.m, '[^0-9]', ''))"
    return {
        "form": form,
        "known": known,
        "context": context,
        "digits": f"least(6, {digits} div 3)",
        "length": f"least(6, length({s}.m) div 6)",
        "spread": f"if(length(regexp_replace({s}.m, '([0-9])(?=.*\\\\1)|[^0-9]', '')) < 3 and {digits} > 6, 1, 0)",
    }


VOTES, SHAPE = ("form", "known", "context"), ("digits", "length", "spread")


def expectation_maximisation(counts: dict[tuple[int, ...], float], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posteriors of vote patterns (kind, votes...), two classes, labelers independent given the class."""
    kinds = sorted({p[0] for p in counts})
    prior = dict.fromkeys(kinds, 0.5)
    rate = {(k, j, v, z): (0.6 if v == (1 if z else -1) else 0.3 if v == 0 else 0.1) for k in kinds for j in range(len(VOTES)) for v in (-1, 0, 1) for z in (0, 1)}
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in counts:
            odds = [math.log(prior[p[0]] if z else 1 - prior[p[0]]) + sum(math.log(rate[p[0], j, v, z]) for j, v in enumerate(p[1:])) for z in (0, 1)]
            post[p] = 1 / (1 + math.exp(min(700, max(-700, odds[0] - odds[1]))))
        for k in kinds:
            own = [(p, n) for p, n in counts.items() if p[0] == k]
            total = sum(n for _, n in own)
            yes = sum(n * post[p] for p, n in own)
            prior[k] = (yes + 1) / (total + 2)
            for z in (0, 1):
                weight = yes if z else total - yes
                for j in range(len(VOTES)):
                    for v in (-1, 0, 1):
                        # Ten votes of prior belief keep a labeler better than chance, so classes can't swap.
                        belief = 6 if v == (1 if z else -1) else 3 if v == 0 else 1
                        hit = sum(n * (post[p] if z else 1 - post[p]) for p, n in own if p[j + 1] == v)
                        rate[k, j, v, z] = (hit + belief) / (weight + 10)
    return post


def train(found: DataFrame) -> dict[tuple[int, str, int], float]:
    """Log odds of the final classifier by (kind, feature, value); feature "prior" holds the kinds' own."""
    features = featured("s")
    each = found.select(F.explode("found").alias("s")).select(F.col("s.k").alias("k"), *(F.expr(sql).cast("int").alias(name) for name, sql in features.items()))
    # At most 9 kinds x 27 vote patterns x 7 x 7 x 2 shapes.
    rows = each.groupBy("k", *features).agg(F.count("*").alias("n")).collect()
    counts: dict[tuple[int, ...], float] = defaultdict(float)
    for r in rows:
        counts[(r["k"], *(r[v] for v in VOTES))] += r["n"]
    post = expectation_maximisation(counts) if counts else {}
    tally: dict[tuple[int, str, int], list[float]] = defaultdict(lambda: [1.0, 1.0])
    total: dict[int, list[float]] = defaultdict(lambda: [1.0, 1.0])
    for r in rows:
        yes = post[(r["k"], *(r[v] for v in VOTES))]
        total[r["k"]][1] += r["n"] * yes
        total[r["k"]][0] += r["n"] * (1 - yes)
        for name in (*VOTES, *SHAPE):
            tally[r["k"], name, r[name]][1] += r["n"] * yes
            tally[r["k"], name, r[name]][0] += r["n"] * (1 - yes)
    weights = {(k, "prior", 0): math.log(t[1] / t[0]) for k, t in total.items()}
    for (k, name, value), (no, yes) in tally.items():
        weights[k, name, value] = math.log(yes / total[k][1]) - math.log(no / total[k][0])
    return weights


def accepted(weights: dict[tuple[int, str, int], float], s: str) -> str:
    """SQL: whether the classifier takes candidate s for personal data."""
    features = featured(s)
    terms = []
    for name in ("prior", *VOTES, *SHAPE):
        by: dict[int, dict[int, float]] = defaultdict(dict)
        for (k, feature, value), w in weights.items():
            if feature == name:
                by[k][value] = w
        for k, values in sorted(by.items()):
            sql = f"{values[0]!r}D" if name == "prior" else f"case {features[name]} {' '.join(f'when {v} then {w!r}D' for v, w in sorted(values.items()))} else 0D end"
            terms.append(f"if({s}.k = {k}, {sql}, 0D)")
    return f"({' + '.join(terms)}) > 0D" if terms else "false"


def _reported(found: DataFrame, weights: dict[tuple[int, str, int], float]) -> DataFrame:
    """Add spans, array<struct<kind, start, end, base>> by start and then by kind, to rows with candidates."""
    base = found.withColumn("base", F.expr(f"filter(found, s -> s.ok and s.k < {len(BASE)})"))
    free = "not exists(base, b -> b.start < s.start + length(s.m) and s.start < b.start + length(b.m))"
    spans = f"concat(base, filter(found, s -> s.k >= {len(BASE)} and {accepted(weights, 's')} and {free}))"
    ordered = f"sort_array(transform({spans}, s -> struct(s.start as start, s.k as k, s.start + length(s.m) as end)))"
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    out = f"transform({ordered}, s -> named_struct('kind', {names}[s.k], 'start', s.start, 'end', s.end, 'base', s.k < {len(BASE)}))"
    return base.withColumn("spans", F.expr(out)).drop("base", "found")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th and spans of every row."""
    stored = durable(candidates(docs, id_col, text_col), "candidates")
    return _reported(stored, train(stored)).withColumnRenamed("id", id_col)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of docs with personal data masked in the text, and its length renewed where it changed."""
    weights = train(durable(candidates(docs, id_col, text_col), "candidates"))
    rows = _searched(docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", ["row"])
    rows = _reported(rows, weights)
    hit = F.size("spans") > 0
    done = rows.select("row", hit.alias("hit"), F.when(hit, masked(F.col("t"), F.col("spans"))).alias("clean"))
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns[text_col] = F.when(F.col("hit"), F.col("clean")).otherwise(columns[text_col])
    if length_col:
        kind = docs.schema[length_col].dataType
        columns[length_col] = F.when(F.col("hit"), F.length("clean").cast(kind)).otherwise(columns[length_col])
    return done.select(*(c.alias(name) for name, c in columns.items()))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans share one cut."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return detect(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


QUERIES = {"op6_weak_supervision_pii": query}
ORACLES: dict[str, str] = {}
