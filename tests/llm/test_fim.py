import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import by_text

from supplylens.llm import fim

CUT = {"char": lambda t: list(t), "word": lambda t: re.findall(r"^[\t-\r ]*[^\t-\r ]*|[\t-\r ]+[^\t-\r ]*", t) if t else [], "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)}


def expected(doc_id, text, unit="char", plain=90):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    parts = CUT[unit](text)
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain:
        return doc_id, n, "plain", None, None, text
    head, mid, tail = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{tail}<P>{head}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{head}<S>{tail}<M>{mid}"


def more_texts():
    rng = random.Random(8)
    pool = ["a", "Z", " ", "\n", "\t", "\r", "é", "ß", "中", "😀", "́", "<", ">", "<P", "S>", "\x00", "P>", "<M"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["a<P>b", "<S>", "x<M>", "<P", "é" * 200_000, "", None]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_matches_a_row_at_a_time(spark, docs, unit):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + k, t) for k, t in enumerate(more_texts())]
    df = spark.createDataFrame([(k, t, "f", 1, "w") for k, t in rows], "doc_id bigint, text string, form string, n int, whole string")
    out = fim.fill_in_middle(df, unit=unit)
    got = [tuple(r) for r in out.collect()]
    assert by_text(got) == by_text(expected(k, t, unit) for k, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = out.select("doc_id", fim.restored(out.output, out.form).alias("t")).collect()
    assert by_text(tuple(r) for r in back) == by_text((k, t or "") for k, t in rows)


def test_query_and_sql(spark, sf, docs):
    want = []
    for r in docs.select("doc_id", "text").collect():
        *most, output = expected(*r)
        want.append((*most, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    df = fim.query(spark, sf)
    assert by_text(tuple(r) for r in df.collect()) == by_text(want)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    assert by_text(con.sql(f"SELECT {', '.join(df.columns)} FROM ({fim.SQL})").fetchall()) == by_text(want)


def test_slices_and_large_offsets():
    """Batches are parts of larger arrays as well, with offsets of 32 or 64 bits."""
    texts = ["zz", "é中a", None, "", "b 😀 c"]
    h = [np.array([k, 7 * k, 3, 50]) for k in range(4)]
    for kind in (pa.string(), pa.large_string()):
        part = pa.array(texts, kind)[1:]
        whole = fim.transform(pa.array(texts[1:], kind), h, np.zeros(4, bool))
        assert {k: v.to_pylist() for k, v in fim.transform(part, h, np.zeros(4, bool)).items()} == {k: v.to_pylist() for k, v in whole.items()}
        assert whole["n"].to_pylist() == [3, 0, 0, 5]


def test_other_marks_and_shares(spark):
    df = spark.createDataFrame([(k, f"text number {k}") for k in range(50)], "id bigint, t string")
    out = fim.fill_in_middle(df, "id", "t", marks=("⟨pre⟩", "⟨suf⟩", "⟨mid⟩"), plain=100, spm=100).collect()
    assert {r["form"] for r in out} == {"spm"} and all(r["output"].startswith("⟨suf⟩") for r in out)
    assert {r["form"] for r in fim.fill_in_middle(df, "id", "t", plain=0).collect()} == {"plain"}


def test_empty_table(empty):
    assert fim.fill_in_middle(empty).count() == 0
