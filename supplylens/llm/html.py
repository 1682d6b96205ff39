"""HTML extraction by equivalence-class template deduction.

A page's tokens are its element paths and its blocks of text at their paths. Tokens with the same
occurrence vector over the different pages of a host form an equivalence class; a class is valid
when it is large and frequent. Near copies of a page count once, so that a shared article isn't
taken for template. Valid classes nest into the one on the most pages when their tokens keep one
order and stand only on pages that hold it; classes that don't nest are no template. What is left
of a page are its slots. Occurrence vectors are compared by a fingerprint that is summed over pages,
so no task sees all pages of a host.

The article is the slots' text outside elements that mark menus, headers, footers, sidebars,
notices, adverts, forms and comments. Where a page marks its article (article, main), only blocks
inside are candidates; on all pages the template then tells repeated blocks from content.

Cases: a null or empty page has an empty text; a null url is a host of its own; broken markup is
read as browsers do as far as blocks go; copies of a page count once in the vectors; repeated or
null ids are rows of their own; pages are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.common import bounded_batches, durable, read

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "head nav header footer aside form script style noscript template svg math iframe button select textarea dialog menu object audio video canvas title".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_NAMES = frozenset(
    """ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie
    cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup
    promo promoted related reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget""".split()
)
#: Words that may stand beside such a name: "ad-slot" and "comment-list" are marks, "ad-free" and "page-header" aren't.
BESIDE = frozenset(
    """area articles bar block bottom box container content global inline item items left links list main menu panel posts primary
    reader right section secondary site slot stories text top unit user widget wrap wrapper""".split()
)
CONTENT = frozenset(["article", "main"])
KEPT = frozenset(["html", "body", "main"])

OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
EDGE = re.compile(r"""[<>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PARTS = re.compile(r"[a-z]+|[0-9]+")
# Min-hashes of a page: two pages with 0.8 of their runs of words in common share a band in 19 of 20 cases.
SHINGLE, BANDS, BAND = 5, 16, 8
ODD = np.random.default_rng(0).integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)"


def _marks(value: str) -> set[str]:
    """The names in a class or id that mark what is no article: all words of a name are marks or stand beside them."""
    found = set()
    for name in value.split():
        words = [w for w in PARTS.findall(name) if not w.isdigit()]
        marks = DROPPED_NAMES.intersection(words)
        if marks and all(w in marks or w in BESIDE for w in words):
            found |= marks
    return found


def _dropped(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in KEPT or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value in DROPPED_ROLES:
            return True
        if key in ("class", "id") and (names := _marks(value)):
            if tag != "article" or names & {"comment", "comments", "related", "promo", "sponsored"}:
                return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name or None, closing, attributes) of comments, declarations and tags, in one walk over the page.

    A tag ends at the first > outside quotes. One that meets another < or the page's end before that
    is broken; it is passed over up to there, so nothing is read twice. The caller may send where to go on.
    """
    at, size = 0, len(page)
    while (at := page.find("<", at)) >= 0:
        m = OPENING.match(page, at)
        if m is None:
            at += 1
            continue
        start, end = at, m.end()
        if m[1]:
            found = page.find("-->", end)
            end = size if found < 0 else found + 3
            name = None
        elif m[2]:
            found = page.find(">", end)
            end = size if found < 0 else found + 1
            name = None
        else:
            name = m[4].lower()
            while (edge := EDGE.search(page, end)) and edge[0] in "\"'":
                found = page.find(edge[0], edge.end())
                end = size if found < 0 else found + 1
            if edge is None or edge[0] == "<":
                name, end = None, size if edge is None else edge.start()
            else:
                end = edge.end()
        at = (yield start, end, name, bool(m[3]), page[m.end() : end - 1]) or end


class Block:
    __slots__ = ("path", "text", "dropped", "region")

    def __init__(self, path: str, text: str, dropped: bool, region: int):
        self.path, self.text, self.dropped, self.region = path, text, dropped, region


class _Open:
    """An open element that isn't inline, with the inline ones inside: for each name, whether they are dropped."""

    __slots__ = ("tag", "path", "dropped", "region", "inline", "hidden")

    def __init__(self, tag: str, path: str, dropped: bool, region: int):
        self.tag, self.path, self.dropped, self.region, self.inline, self.hidden = tag, path, dropped, region, None, 0


# Elements whose start ends an open one of the same kind, up to the elements that hold them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ()),
}


def blocks(page: str) -> list[Block]:
    """The blocks of text in page order. region: the number of the outermost article or main around, 0 outside."""
    found: list[Block] = []
    stack, count = [_Open("", "", False, 0)], Counter()
    parts: list[str] = []
    regions = 0

    def close() -> None:
        """End the block; it belongs to the innermost element that isn't inline."""
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1]
                found.append(Block(top.path, text, top.dropped or top.hidden > 0, top.region))

    def leave(size: int) -> None:
        while len(stack) > size:
            count[stack.pop().tag] -= 1

    at, lower, walk, go = 0, None, _tags(page), None
    while True:
        try:
            start, end, tag, closing, attributes = walk.send(go)
        except StopIteration:
            break
        go = None
        if start > at:
            parts.append(page[at:start])
        at = end
        if tag is None:
            continue
        top = stack[-1]
        if closing:
            if tag in INLINE:
                if top.inline and (own := top.inline.get(tag)):
                    if own[-1]:
                        close()
                        top.hidden -= 1
                    own.pop()
                continue
            close()
            if count[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                leave(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag not in VOID:
                drops = _dropped(tag, attributes)
                if drops:
                    close()
                    top.hidden += 1
                if top.inline is None:
                    top.inline = {}
                top.inline.setdefault(tag, []).append(drops)
            continue
        close()
        same, stop = ENDS.get(tag, (("p",), ()))
        k = len(stack) - 1
        while k and stack[k].tag == "p" and "p" not in same:  # a block ends an open paragraph
            k -= 1
        if k and stack[k].tag in same and stack[k].tag not in stop:
            leave(k)
        elif k < len(stack) - 1:
            leave(k + 1)
        top = stack[-1]
        if tag in VOID or attributes.endswith("/"):
            continue
        drops, region = top.dropped or top.hidden > 0 or _dropped(tag, attributes), top.region
        if tag in CONTENT and not region and not drops:
            regions += 1
            region = regions
        stack.append(_Open(tag, xxhash.xxh3_64_hexdigest(f"{top.path}/{tag}"), drops, region))
        count[tag] += 1
        if tag in RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]", lambda c: c[0].lower(), page)
            go = lower.find(f"</{tag}", at)
            go = len(page) if go < 0 else go
            if go > at:
                parts.append(page[at:go])
            at = go
    if at < len(page):
        parts.append(page[at:])
    close()
    return found


def article(found: list[Block]) -> tuple[list[Block], bool]:
    """The candidate blocks, and whether the page marks them as its articles."""
    kept = [b for b in found if not b.dropped]
    marked = [b for b in kept if b.region]
    return marked or kept, bool(marked)


def _token(path: str, text: str = "") -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") - (1 << 63)


def _sketch(found: list[Block], page: int) -> list[int]:
    """BANDS keys of the min-hashes of the text's runs of five words; near copies share one with high probability."""
    words = [xxhash.xxh3_64_intdigest(w) for b in found for w in b.text.split()]
    if not words:
        return [page] * BANDS
    w = np.array(words, np.uint64)
    n = max(1, len(w) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        runs = (runs * np.uint64(0x9E3779B97F4A7C15)) ^ w[k : k + n]
    runs ^= runs >> np.uint64(31)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(29)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, n, 2048):
        mixed = runs[k : k + 2048, None] * ODD
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    return [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in least.reshape(BANDS, BAND)]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("token", pa.int64()), ("n", pa.int32()), ("content", pa.bool_())])
    for batch in batches:
        pages, bands, counts = [], [], []
        for page in batch.column(1).to_pylist():
            seen, found = Counter(), blocks(page or "")
            kept = article(found)[0]
            content = {_token(b.path, b.text) for b in kept}
            for b in found:
                seen[_token(b.path)] += 1
                seen[_token(b.path, b.text)] += 1
            pages.append(xxhash.xxh3_64_intdigest(page or "") - (1 << 63))
            bands.append(_sketch(kept, pages[-1]))
            # In the order of their first places.
            counts.append([{"token": t, "n": n, "content": t in content} for t, n in seen.items()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(pages, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(counts, pa.list_(kind))], ["host", "page", "bands", "tokens"]
        )


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and class of its host that it holds: a hash of the order of its tokens, and whether the outermost class is there."""
    for batch in batches:
        hosts, numbers, orders, roots = [], [], [], []
        for host, tokens, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            of = {t: k for k, c in enumerate(classes) for t in c}
            found: dict[int, list[int]] = {}
            for t in tokens:
                if t in of:
                    found.setdefault(of[t], []).append(t)
            for k, own in found.items():
                hosts.append(host)
                numbers.append(k)
                orders.append(xxhash.xxh3_64_intdigest(np.array(own, np.int64).tobytes()) - (1 << 63))
                roots.append(0 in found)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(numbers, pa.int32()), pa.array(orders, pa.int64()), pa.array(roots, pa.bool_())], ["host", "number", "order", "root"])


def distinct_pages(tokens: DataFrame) -> DataFrame:
    """Of near copies on a host one page: pages that are the least of every band that they share."""
    least = tokens.select("host", "page", F.posexplode("bands").alias("band", "key")).groupBy("host", "band", "key").agg(F.min("page").alias("page"))
    ones = least.groupBy("host", "page").agg(F.count("*").alias("least")).where(F.col("least") == BANDS).alias("b")
    same = F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.page") == F.col("b.page"))
    return tokens.alias("a").join(ones, same, "left_semi")


def templates(pages: DataFrame, least_pages: int = 3, least_share: float = 0.5, least_size: int = 2) -> DataFrame:
    """(host, template): the text tokens of the nested valid classes of each host; pages has (host, html)."""
    tokens = pages.select("host", "html").mapInArrow(_tokens, "host string, page bigint, bands array<bigint>, tokens array<struct<token:bigint,n:int,content:boolean>>")
    tokens = durable(tokens.dropDuplicates(["host", "page"]), "page-tokens")
    tokens = durable(distinct_pages(tokens).drop("bands"), "distinct-tokens")
    size = tokens.groupBy("host").agg(F.count("*").alias("pages"))
    each = tokens.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    vectors = each.groupBy("host", "token").agg(F.count("*").alias("support"), F.expr("bit_xor(xxhash64(page, n))").alias("vector"), F.max("content").alias("content"))
    same = F.col("a.host").eqNullSafe(F.col("b.host"))
    frequent = vectors.alias("a").join(size.alias("b"), same).where((F.col("support") >= least_pages) & (F.col("support") >= least_share * F.col("pages"))).select("a.*")
    # At most pages / support = 1 / least_share times a page's tokens are frequent, so a host's class is small.
    classes = frequent.groupBy("host", "support", "vector").agg(F.collect_list("token").alias("tokens"), F.collect_list(F.when(F.col("content"), F.col("token"))).alias("content")).where(F.size("tokens") >= least_size)
    tree = classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("support", F.size("tokens").alias("size"), "vector", "tokens", "content")), asc=False).alias("classes"))
    tree = durable(tree.where(F.exists("classes", lambda c: F.size(c["content"]) > 0)), "classes").alias("b")
    # A class nests when its tokens stand in one order on all of its pages and the outermost class is on each of them.
    held = tokens.alias("a").join(tree, same).select("a.host", F.col("tokens.token").alias("tokens"), F.col("classes.tokens").alias("classes"))
    held = held.mapInArrow(_orders, "host string, number int, order bigint, root boolean")
    nested = held.groupBy("host", "number").agg((F.min("order") == F.max("order")).alias("ordered"), F.min("root").alias("inside"))
    nested = nested.where("ordered AND inside").groupBy("host").agg(F.collect_list("number").alias("numbers")).alias("a")
    chosen = F.flatten(F.transform("numbers", lambda k: F.get(F.col("classes.content"), k)))
    return durable(nested.join(tree, same).select("a.host", chosen.alias("template")).where(F.size("template") > 0), "templates")


BLOCK_TYPE = pa.struct([("token", pa.int64()), ("text", pa.string())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[{"token": _token(b.path, b.text), "text": b.text} for b in article(blocks(page or ""))[0]] for page in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.list_(BLOCK_TYPE))], ["id", "url", "host", "blocks"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and the article's text of every row."""
    bounded_batches(pages.sparkSession, 500)
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.lower(F.regexp_extract(F.col(url_col).cast("string"), HOST, 1)).alias("host"), F.col(html_col).cast("string").alias("html")
    )
    kind = rows.schema["id"].dataType.simpleString()
    found = templates(rows).alias("b")
    own = rows.mapInArrow(_extract, f"id {kind}, url string, host string, blocks array<struct<token:bigint,text:string>>").alias("a")
    slots = F.filter("blocks", lambda b: F.col("template").isNull() | ~F.array_contains("template", b["token"]))
    joined = own.join(found, F.col("a.host").eqNullSafe(F.col("b.host")), "left")
    return joined.select(F.col("a.id").alias(id_col), F.col("a.url").alias(url_col), F.array_join(F.transform(slots, lambda b: b["text"]), "\n\n").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op4_template_extraction": query}
ORACLES: dict[str, str] = {}
