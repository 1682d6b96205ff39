import datetime as dt
import math
import random
import zlib

import numpy as np
import pytest
from conftest import by_text
from pyspark.sql import functions as F

from supplylens.llm import lots

LINE = "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, q string, part int, client_id string"
SALE = "sale_id bigint, client_id bigint, status string, line bigint"


def brute(lines, sales):
    """By the definition: one return after the other, looking through all lots."""
    owners, groups = {}, {}
    for s, client in sales:
        if s is not None and client is not None:
            owners.setdefault(s, []).append(client)
    for sale, line, item, q, amount, discount, flag, shipped in lines:
        if None in (sale, item, q, amount, shipped) or q < 1 or not abs(amount) < lots.MOST:
            continue
        for client in owners.get(sale, ()):
            c, d = math.floor(100 * amount + 0.5), math.floor(100 * discount + 0.5) if discount is not None and math.isfinite(discount) else 0
            h = zlib.crc32(f"{sale}:{'' if line is None else line}".encode())
            day = (shipped.date() - dt.date(1970, 1, 1)).days
            low = -math.inf if line is None else line
            g = groups.setdefault((client, item), ([], []))
            g[0].append({"key": (-day, sale, low, q, c, d), "day": day, "sale": sale, "line": line, "q": q, "c": c, "left": q})
            if flag == "returned":
                g[1].append((day + 1 + h % 13, sale, low, q, c, d, 1 + h % (q + 10)))
    out = []
    for (client, item), (have, back) in groups.items():
        have.sort(key=lambda x: x["key"])
        for no, (day, sale, _, q, c, d, units) in enumerate(sorted(back), 1):
            taken = piece = 0
            refund = lambda n: n * c * (100 - d) // (100 * q)  # noqa: E731, B023
            for x in have:
                if x["day"] < day and x["left"] and taken < units:
                    n, piece = min(x["left"], units - taken), piece + 1
                    cost = (x["q"] - x["left"] + n) * x["c"] // x["q"] - (x["q"] - x["left"]) * x["c"] // x["q"]
                    x["left"] -= n
                    r = refund(taken + n) - refund(taken)
                    taken += n
                    out.append((client, item, no, piece, day, sale, x["sale"], x["line"], n, x["left"], r, r - cost))
            if taken < units:
                out.append((client, item, no, piece + 1, day, sale, None, None, units - taken, None, refund(units) - refund(taken), None))
    return out


def random_rows(rng, n, clients=3, items=3, days=20):
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(rng.randint(0, days), seconds=rng.choice([0, 0, 86399]))
    maybe = lambda x: None if rng.random() < 0.02 else x
    sales = [(maybe(k), maybe(rng.choice([0, 0, 0, *range(clients)]))) for k in range(n // 3)] + [(1, 0), (1, 0)]
    lines = [
        (maybe(rng.randint(0, n // 3)), maybe(rng.randint(1, 3)), maybe(rng.choice([7, 7, *range(items)])), maybe(rng.choice([0, -1, 1, 2, 5, 50])), maybe(rng.choice([math.nan, 0.0, -3.5, 1.005, 99.99, 1e300, 12.34])), maybe(rng.choice([0.0, 0.07, math.nan, 0.1])), rng.choice(["returned", "returned", "kept", None]), maybe(day()))
        for _ in range(n)
    ]
    return lines + lines[: n // 10], sales


def frames(spark, lines, sales):
    rows = [(s, ln, i, 1, q, a, d, f, t, "q", 5, "x") for s, ln, i, q, a, d, f, t in lines]
    return spark.createDataFrame(rows, LINE), spark.createDataFrame([(s, c, "done", 3) for s, c in sales], SALE)


def test_queue_orders_rows_through_runs():
    rng = np.random.default_rng(4)
    queue = lots.ExternalQueue(4, 3, buffer=50, block=7, fan=3)
    want, got, low = [], [], None
    for _ in range(60):
        rows = [rng.integers(0, 5, 13), rng.integers(0, 4, 13), rng.integers(0, 9, 13), rng.integers(0, 99, 13)]
        queue.push(rows)
        want += list(zip(*(x.tolist() for x in rows), strict=True))
        assert len(queue.runs) < 3 and queue.count < 50
    for rows in queue.drain():
        assert len(rows[0]) <= 3 * 7 + 50
        got += list(zip(*(x.tolist() for x in rows), strict=True))
    assert [r[:3] for r in got] == sorted(r[:3] for r in want) and sorted(got) == sorted(want)


def test_queue_takes_rows_while_it_gives_some():
    rng, queue, held = random.Random(3), lots.ExternalQueue(1, 1, buffer=20, block=4, fan=3), []
    for step in range(400):
        if rng.random() < 0.6:
            new = [rng.randint(0, 1000) for _ in range(rng.randint(1, 9))]
            queue.push([np.array(new)])
            held += new
        elif held:
            got = queue.pop()[0].tolist()
            held.sort()
            assert got == held[: len(got)], step
            del held[: len(got)]
    assert [x for rows in queue.drain() for x in rows[0].tolist()] == sorted(held) and queue.pop() is None


def test_stack_spills():
    stack, want = lots.Stack(held=4), []
    for k in range(50):
        stack.lots.append((k, 1, 2, 3))
        stack.left.append(k)
        want.append(k)
        stack.trim()
        if k % 3 == 0:
            assert stack.fill() and stack.lots.pop()[0] == want.pop() and len(stack.lots) <= 4
            stack.left.pop()
    while stack.fill():
        assert stack.lots.pop()[0] == want.pop()
        stack.left.pop()
    assert not want


@pytest.mark.parametrize(("seed", "partitions"), [(1, 1), (2, 7), (3, 40)])
def test_matches_brute_force(spark, seed, partitions):
    """Also with groups over many tasks, and buffers, blocks and stacks of a few rows."""
    lines, sales = random_rows(random.Random(seed), 900)
    want = by_text(brute(lines, sales))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = by_text(tuple(r) for r in lots.match_returns(*frames(spark, lines, sales), buffer=40, block=6, held=5).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(want) > 300 and got == want


def test_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/sale_lines.parquet").select("sale_id", "line_no", "item_id", "quantity", "amount", "discount", "flag", "shipped_at")
    sales = spark.read.parquet(f"{sf}/sales.parquet").select("sale_id", "client_id")
    want = brute([tuple(r) for r in lines.collect()], [tuple(r) for r in sales.collect()])
    df = lots.query(spark, sf)
    assert df.columns == ["client_id", "item_id", "return_no", "piece_no", "return_day", "return_sale_id", "lot_sale_id", "lot_line_no", "units", "lot_left", "refund_cents", "margin_cents"]
    assert {t for _, t in df.dtypes} == {"bigint"}
    assert by_text(tuple(r) for r in df.collect()) == by_text(want) and len(want) > 100


def test_empty_tables(spark):
    lines, sales = spark.createDataFrame([], LINE), spark.createDataFrame([], SALE)
    assert lots.match_returns(lines, sales).count() == 0
    one = [(1, None, 2, 3, 5.0, None, "returned", dt.datetime(2024, 1, 1))]
    assert lots.match_returns(*frames(spark, one, [])).count() == 0
    assert by_text(tuple(r) for r in lots.match_returns(*frames(spark, one, [(1, 4)])).collect()) == by_text(brute(one, [(1, 4)]))


def test_whole_numbers_round_down(spark):
    cases = [(n, v, s) for n in (0, 1, 7, 60) for v in (-350, -1, 0, 5, 99999) for s in (1, 3, 5000)]
    df = spark.createDataFrame(cases, "n bigint, v bigint, s bigint").select("n", "v", "s", lots._whole(F.col("n"), F.col("v"), F.col("s")).alias("x"))
    assert all(r["x"] == r["n"] * r["v"] // r["s"] for r in df.collect())
