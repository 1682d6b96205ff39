import time
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import by_text

from supplylens.llm import html, jaccard, neighbours, quality, sharding
from supplylens.llm.common import ranked


def duck(sf, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    return con.sql(sql).fetchall()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def set_of(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def linked(rows, n, percent):
    """The root of each row's component, by comparing all pairs."""
    sets, root = [set_of(t, n) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and 100 * k >= percent * (len(a) + len(sets[j]) - k):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], sets


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_join_matches_all_pairs(spark, docs, n, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    roots, sets = linked(rows, n, percent)
    least = {}
    for (k, _), r in zip(rows, roots, strict=True):
        if k is not None:
            least[r] = min(least.get(r, k), k)
    want = [(k, len(s), least.get(r)) for (k, _), r, s in zip(rows, roots, sets, strict=True)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs, n, percent).collect()]
    assert by_text(got) == by_text(want)
    kept = jaccard.keep_one(docs, n, percent)
    assert kept.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    full = [r for r, s in zip(roots, sets, strict=True) if s]
    assert sorted(k for k, t in kept if set_of(t, n) and k is not None) == sorted(v for r, v in least.items() if r in full)


def test_family_of_near_copies(spark):
    """Chains of edits, so that far members are linked only through others, and one outlier."""
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        text = words[:]
        for j in range(k // 3):
            text[(7 * j) % 300] = f"x{j}"
        rows.append((k, " ".join(text)))
    rows.append((60, " ".join([*words[:150], *(f"y{k}" for k in range(150))])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    roots, _ = linked(rows, 3, 90)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar(df).collect()}
    assert got == {k: min(j for j in range(61) if roots[j] == roots[k]) for k in range(61)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {tuple(r) for r in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(k, 0) for k in range(1, 41)} | {(101, 100), (102, 100)}


def test_join_query_and_sql(spark, sf):
    got = [tuple(r) for r in jaccard.query(spark, sf).collect()]
    named = lambda rows: by_text(r for r in rows if r[0] is not None)
    # The SQL has one row for each id; repeated rows come out as often.
    want = duck(sf, jaccard.SQL.replace("SELECT d.doc_id, coalesce(n.n", "SELECT DISTINCT d.doc_id, coalesce(n.n"))
    assert set(named(got)) == set(named(want))


def test_quality_query_and_sql(spark, sf):
    df = quality.query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({quality.SQL})").fetchall()
    assert by_text(got) == by_text(want)


def test_quality_by_brute_force(spark, docs):
    def base(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)

    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.judge(docs).collect()]
    assert by_text(got) == by_text((r["doc_id"], *base(r["text"])) for r in docs.collect())


def test_boilerplate_and_copies(spark):
    """A line on many different pages is removed; copies of a page don't make its lines boilerplate."""
    own = lambda k: " ".join(f"own{k}w{j}" for j in range(60))
    notice = "all rights reserved by the publisher of this page"
    rows = [(k, f"{own(k)}\n{notice.upper() if k % 2 else notice}", "h") for k in range(30)]
    rows += [(100 + k, "\n".join([notice] * 5 + [" ".join(f"n{k}z{j}" for j in range(6))]), "h") for k in range(2)]
    copied = own(500) + "\n" + own(501) + " longer"
    rows += [(200 + k, copied, "h") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r["doc_id"]: (r["kept"], r["n_boilerplate_words"]) for r in quality.judge(df).collect()}
    assert all(kept[k] == (True, 9) for k in range(30)) and all(kept[200 + k] == (True, 0) for k in range(40))
    assert all(kept[100 + k][0] is False for k in range(2))
    assert {r["doc_id"] for r in quality.keep(df).collect()} == {k for k, v in kept.items() if v[0]}


def test_long_boilerplate_and_copies(spark):
    """A notice that is each document's longest line is boilerplate, also where near copies of one page hold it too."""
    notice = " ".join(f"notice{j}" for j in range(60))
    rows = [(k, f"title {k}\n{notice}", "short") for k in range(50)]
    own = lambda k: " ".join(f"own{k}w{j}" for j in range(70))
    rows += [(100 + k, f"{own(k)}\n{notice}", "mixed") for k in range(20)]
    rows += [(200 + k, f"{own(500)}\n{notice}\ncopy {k}", "mixed") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: (r["kept"], r["n_boilerplate_words"]) for r in quality.judge(df).collect()}
    assert all(got[k] == (False, 60) for k in range(50)) and all(got[100 + k] == (True, 60) for k in range(20))


def test_equal_rows_on_two_hosts_are_judged_apart(spark):
    """A line that is boilerplate on one host only leaves that host's rows only, whatever their ids."""
    line, body = "one two three four five six seven eight nine", [f"w{k}" for k in range(60)]
    text = " ".join(body) + "\n" + line
    rows = [(k, f"{' '.join(f'v{k}x{j}' for j in range(60))}\n{line}", "A") for k in range(1, 12)] + [(0, text, "A"), (0, text, "B"), (0, text, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(r["n_boilerplate_words"] for r in quality.judge(df).collect() if r["doc_id"] == 0)
    assert got == [0, 0, 9]
    kept = {r["source"]: r["text"] for r in quality.keep(df).collect() if r["doc_id"] == 0}
    assert kept == {"A": " ".join(body), "B": text, None: text}


def test_quality_keep_equals_judge(spark, docs):
    judged = by_text(r["doc_id"] for r in quality.judge(docs).where("kept").collect())
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and by_text(r["doc_id"] for r in kept.collect()) == judged


def test_sharding(spark, docs, sf):
    rows = sharding.query(spark, sf).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()]
    assert by_text((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == by_text(want)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts.get(k, 0) for k in range(8)) <= 1
    for k in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k]))


def test_sharding_groups_and_hot_group(spark):
    rows = [(k, f"group {k // 4}" if k < 80 else f"single {k}") for k in range(400)]
    rows += [(1000 + k, "the same text") for k in range(200)]  # a third of all rows
    out = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    counts = Counter(r["shard"] for r in out)
    assert sorted(counts.values()) == [75] * 8
    at = {r["doc_id"]: r["shard"] for r in out}
    cut = sum(len({at[4 * g + j] for j in range(4)}) > 1 for g in range(20))
    hot = Counter(at[1000 + k] for k in range(200))
    assert cut <= 3 and max(hot.values()) >= 60


@pytest.mark.parametrize("linked_rows", [4000, 3600, 2800])
def test_sharding_of_full_shards(spark, linked_rows):
    """Where all or most rows have copies, shards without room swap parts."""
    rows = [(k, f"pair {k // 2}" if k < linked_rows else f"single {k}") for k in range(4000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [500] * 8
    at = {r["doc_id"]: r["shard"] for r in out}
    assert sum(at[2 * g] != at[2 * g + 1] for g in range(linked_rows // 2)) <= 0.01 * linked_rows // 2


def test_ranked_numbers_each_key(spark):
    df = spark.createDataFrame([(k % 3 if k % 3 else None, k) for k in range(100)], "key int, v int")
    got = ranked(df, ["key"], [df.v], "place").collect()
    for key in (None, 1, 2):
        own = [r["place"] for r in got if r["key"] == key]
        assert sorted(own) == list(range(len(own)))


def exact(ids, x, step=50, k=5):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % step == 0:
            s = (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[i] = [ids[j] for j in order]
    return out


def test_neighbours_recall_and_ties(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1200, 24)).astype(np.float32).astype(float)
    x[300:330] = x[0]  # equal vectors tie by id
    ids = np.arange(1200)
    rows = [(int(i), [float(c) for c in v], 0, "x") for i, v in zip(ids, x, strict=True)]
    odd = [(2000, None, 0, ""), (2050, [0.0] * 24, 0, ""), (2100, [float("nan")] * 24, 0, ""), (2150, [None] + [1.0] * 23, 0, ""), (2200, [1.0], 0, ""), (None, [1.0] * 24, 0, ""), (2250, [], 0, ""), (2300, [float("inf")] * 24, 0, "")]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int, score string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in neighbours.query(spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(ids, x)
    assert set(got) == set(want)
    assert sum(len({v for v, _ in got[q].values()} & set(want[q])) for q in want) / (5 * len(want)) >= 0.9
    assert [got[0][k][0] for k in range(1, 6)] == [300, 301, 302, 303, 304]
    q, (v, s) = 50, got[50][1]
    assert abs(s - x[q] @ x[v] / np.linalg.norm(x[q]) / np.linalg.norm(x[v])) < 1e-12


def test_neighbours_small_blocks_and_empty(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(x)]
    df = neighbours.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    few, many = (neighbours.search(df, df.where("id % 50 = 0"), block=b).collect() for b in (20, 4000))
    assert by_text(few) == by_text(many)
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


ARTICLE = "<article><header>By line</header><h1>Title &amp; more</h1><p>One <b>bold</b>\n  text<br>next</p><aside>side</aside><p>Two &eacute;&#33;<ul><li>a<li>b</ul><div class='comments'><p>reader</p></div><form>f</form><div class='ad-box'>buy</div></article>"


def test_html_article():
    page = f"<html><head><title>t</title><script>if (a<b) '</p>'</script></head><body class='no-sidebar'><nav>menu</nav><!-- <p>no</p> -->{ARTICLE}<div id='notice'>n</div><footer>foot</footer>"
    kept, marked = html.article(html.blocks(page))
    assert marked and [b.text for b in kept] == ["Title & more", "One bold text next", "Two é!", "a", "b"]
    assert html.blocks("") == [] and [b.text for b in html.blocks("<p>cut <b>off")] == ["cut off"]
    assert [b.text for b in html.blocks("a < b <p>x>y")] == ["a < b", "x>y"]
    assert len(html.blocks("<div>" * 20_000 + "x")) == 1


def test_html_templates(spark):
    """Without an article mark, blocks that are on most pages of a host are template."""
    page = lambda h, k: f"<body><div>Site {h}</div><div>Latest | About</div><p>Story {k} of {h} is told here</p><div>Follow us</div></body>"
    rows = [(k, f"https://{h}.example/{k}", page(h, k)) for h in ("a", "b") for k in range(6)]
    rows += [(50, "https://c.example/1", page("c", 1)), (51, None, None), (52, "", ""), (53, "https://a.example/9", ARTICLE), rows[0]]
    got = [(r["page_id"], r["url"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()]
    want = [(k, u, f"Story {k} of {u[8]} is told here") for k, u, _ in rows[:12]] + [(0, rows[0][1], "Story 0 of a is told here")]
    want += [(50, rows[12][1], "Site c\n\nLatest | About\n\nStory 1 of c is told here\n\nFollow us"), (51, None, ""), (52, "", ""), (53, "https://a.example/9", "Title & more\n\nOne bold text next\n\nTwo é!\n\na\n\nb")]
    assert by_text(got) == by_text(want)


def test_html_templates_of_marked_pages(spark):
    """Blocks that all pages of a host repeat inside their article are template too."""
    own = lambda k: " ".join(f"story{k}word{j}" for j in range(30))
    page = lambda k: f"<body><article><h1>Our paper</h1><p>{own(k)}</p><p>Read on in print</p></article></body>"
    rows = [(k, "https://m.example/", page(k)) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: own(k) for k in range(5)}


def test_html_near_copies_are_no_template(spark):
    """A host that is mostly near copies of one article keeps its text."""
    story = "".join(f"<p>{' '.join(f'part{i}word{j}' for j in range(30))}</p>" for i in range(4))
    page = lambda k: f"<body><div>{story}</div><p>Printed on day {k}</p></body>"
    other = lambda k: f"<body><div><p>{' '.join(f'other{k}word{j}' for j in range(40))}</p></div></body>"
    rows = [(k, "https://a.example/x", page(k)) for k in range(8)] + [(20 + k, "https://a.example/y", other(k)) for k in range(4)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("part0word0" in got[k] and f"day {k}" in got[k] for k in range(8)) and all(got[20 + k].startswith(f"other{k}word0") for k in range(4))


def test_html_classes_nest_in_order(spark):
    """Blocks that change their order from page to page are no template."""
    def page(k):
        own = " ".join(f"story{k}word{j}" for j in range(30))
        a, b = ("<p>alpha block</p>", "<div>beta block</div>")[:: 1 if k % 2 else -1]
        return f"<body><h1>Site name</h1>{a}<div>{own}</div>{b}<h2>Site end</h2></body>"

    rows = [(k, "https://n.example/", page(k)) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("alpha block" in got[k] and "beta block" in got[k] for k in range(6))


def test_empty_tables(spark, empty):
    assert jaccard.similar(empty).count() == 0 and jaccard.keep_one(empty).columns == empty.columns
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_markup_is_read_in_one_walk():
    """Broken pages of a megabyte, and names that only look like marks."""
    began = time.time()
    for page in ("<a " * 350_000, "<div>" * 50_000 + "</x>" * 50_000 + "</div>" * 50_000, "<i>" * 30_000 + "<b>" * 30_000 + "</i>" * 30_000, "<a '\"" * 100_000, "<!--" * 200_000, "<p>" * 100_000):
        assert html.blocks(page) == []
    assert time.time() - began < 20
    page = """<article><div class="ad-free">a</div><div class="page-header"><h2>b</h2></div><p class="social-history">c <b>d</b> e
      <div class="ad-slot">x</div><span class="comments">y</span>f<br/>g &lt; h 1 < 2</article><p>outside</p><article>two"""
    assert [b.text for b in html.article(html.blocks(page))[0]] == ["a", "b", "c d e", "f g < h 1 < 2", "two"]


def test_boilerplate_leaves_the_text(spark):
    """A notice that is the longest line of many documents is removed, whatever else stands there."""
    notice = " ".join(f"n{k}" for k in range(80))
    rows = [(k, f"title {k}\n\n{notice}\n" + " ".join(f"w{k}x{j}" for j in range(60)) + f"\n {notice.upper()} \nend{k}", "a", 5) for k in range(60)]
    rows += [(100 + k, f"only {k}\n{notice}", "a", 5) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    judged = {r["doc_id"]: (r["n_boilerplate_words"], r["kept"]) for r in quality.judge(df).collect()}
    assert judged == {k: (160, True) for k in range(60)} | {100 + k: (80, False) for k in range(20)}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in quality.keep(df, length_col="n_chars").collect()}
    want = {k: t.split("\n") for k, t, _, _ in rows[:60]}
    assert got == {k: ("\n".join([t[0], "", t[3], t[5]]), len("\n".join([t[0], "", t[3], t[5]]))) for k, t in want.items()}
