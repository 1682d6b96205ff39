import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from supplylens.streaming import guards


def plain_limits(events, most, window):
    """One attempt after the other."""
    passed, out = {}, {}
    for k, user, ts in sorted(events, key=lambda e: (e[2], e[0])):
        mine = [t for t in passed.get(user, []) if (ts - t).total_seconds() < window]
        out[k] = len(mine) < most
        passed[user] = [*mine, ts] if out[k] else mine
    return out


@pytest.fixture(scope="module")
def events():
    rng, t = random.Random(6), dt.datetime(2024, 1, 30, 20)
    out = []
    for k in range(600):
        t += dt.timedelta(seconds=rng.choice([0, 1, 30, 90, 400, 2000]))
        out.append((k, rng.choice([1, 1, 1, 2, 3, 4]), t, round(rng.uniform(-1, 40), 2)))
    return out


SCHEMA = "event_id bigint, user_id bigint, ts timestamp_ntz, value double"


def test_limits_of_a_batch(spark, events):
    df = spark.createDataFrame(events, SCHEMA).repartition(5)
    for most, window in ((1, 600), (3, 3600), (2, 10_000)):
        got = {r["event_id"]: (r["allowed"], r["wait"]) for r in guards.limited(df, most, window).collect()}
        want = plain_limits([e[:3] for e in events], most, window)
        assert {k: v[0] for k, v in got.items()} == want and all((w == 0) == a and 0 <= w <= window for a, w in got.values())
        assert set(want.values()) == {True, False}


def test_budget_of_a_batch(spark, events):
    df = spark.createDataFrame(events, SCHEMA).repartition(5)
    got = {r["event_id"]: (r["day"], r["spent_before"], r["allowed"]) for r in guards.budgeted(df, 900.0).collect()}
    spent = {}
    for k, _, ts, cost in sorted(events, key=lambda e: (e[2], e[0])):
        day = str(ts.date())
        assert got[k] == (day, pytest.approx(spent.get(day, 0)), round(spent.get(day, 0) * 100) < 90_000)
        spent[day] = round(spent.get(day, 0) + max(0, cost), 2)
    assert len(spent) > 1 and {x[2] for x in got.values()} == {True, False}


def run_stream(spark, make, schema, path, name, rounds):
    """Feed a folder file by file, stop, and go on from the checkpoint with what has come meanwhile."""
    for part in rounds:
        for rows in part:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        q = make(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/{name}-state").outputMode("append").trigger(availableNow=True).start(f"{path}/{name}")
        q.awaitTermination(240)
        assert q.exception() is None
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def test_streams_equal_batches_across_a_restart(spark, events, tmp_path):
    parts = [events[k : k + 120] for k in range(0, 600, 120)]
    df = spark.createDataFrame(events, SCHEMA)
    got = run_stream(spark, lambda s: guards.limited_stream(s, 2, 3600), guards.LIMITED, f"{tmp_path}/a", "limits", [parts[:2], parts[2:]])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, guards.limited(df, 2, 3600).collect()))
    got = run_stream(spark, lambda s: guards.budgeted_stream(s, 900.0), guards.SPENT, f"{tmp_path}/b", "spent", [parts[:3], parts[3:]])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, guards.budgeted(df, 900.0).collect()))
    late = [(9_999, 1, events[0][2] - dt.timedelta(days=2), 1.0)]
    got = run_stream(spark, lambda s: guards.budgeted_stream(s, 900.0), guards.SPENT, f"{tmp_path}/b", "spent", [[late]])
    assert got.where(F.col("event_id") == 9_999).count() == 0 and got.count() == 600
