import datetime as dt

import pytest
from pyspark.sql import functions as F

from supplylens.sources import files


def test_csv_by_name(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('date,extra,week,event_type\n2001-06-29,x,1,"a, b"\n2001-06-30,y,1,\n2001-07-01,z,2,\n2001-07-28,z,5,\n2001-07-29,z,6,\n')
    days = files.csv(spark, f"file://{path}", "week int, date date, event_type string")
    assert days.columns == ["week", "date", "event_type"]
    past = files.calendar(days, "2001-06-29", "2001-06-30").orderBy("date").collect()
    assert [tuple(r) for r in past] == [(1, dt.date(2001, 6, 29), "a, b"), (1, dt.date(2001, 6, 30), None)]
    assert sorted(r["week"] for r in files.future_calendar(days, "2001-06-30").collect()) == [2, 5]
    with pytest.raises(ValueError, match="snap"):
        files.csv(spark, f"file://{path}", "snap boolean")


def test_csv_files_in_two_orders_are_not_mixed_up(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n20,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.csv(spark, f"file://{tmp_path}", "a int, b int").collect()
    (tmp_path / "b.csv").write_text("a,b\n10,20\n")
    assert sorted(map(tuple, files.csv(spark, f"file://{tmp_path}", "b int, a int").collect())) == [(2, 1), (20, 10)]
    assert sorted(map(tuple, files.csv(spark, f"file://{tmp_path}", "b int").collect())) == [(2,), (20,)]


def test_csv_with_a_row_that_does_not_fit(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("week\n1\nsoon\n")
    with pytest.raises(Exception, match="(?i)malformed|soon"):
        files.csv(spark, f"file://{path}", "week int").collect()


def test_wide_units(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("item,state,d_1,d_2,d_3\na,CA,0,2,9\nb,TX,1,1,1\nc,CA,3,,7\n")
    long = files.wide_units(spark, f"file://{path}", ["item"], ["d_1", "d_2"], F.col("state") == "CA")
    assert sorted(map(tuple, long.collect())) == [("a", "d_2", 2), ("c", "d_1", 3)]
    with pytest.raises(ValueError, match="d_9"):
        files.wide_units(spark, f"file://{path}", ["item"], ["d_9"])


def test_weekly_prices(spark):
    book = spark.createDataFrame([("A_1", "x", 1, 1.005), ("AB1", "x", 1, 2.0), ("A_1", "x", 3, 4.0)], "store string, dept string, week int, price double")
    weeks = spark.createDataFrame([(1,), (1,), (2,)], "week int")
    assert [tuple(r) for r in files.weekly_prices(book, r"A\_%", weeks).collect()] == [("A_1", "x", 1, 1.0)]
    assert files.weekly_prices(book, "A_%", weeks).count() == 2


def test_lines_append_resume_last(spark, tmp_path):
    path, schema = f"file://{tmp_path}/runs", "id string, turn int, answer string"
    files.append_lines(spark.createDataFrame([("q1", 1, None), ("q2", 1, "é\n")], schema), path)
    files.append_lines(spark.createDataFrame([("q1", 2, "b")], schema), path)
    lines = files.read_lines(spark, path, schema)
    assert sorted(map(tuple, files.last_of_each(lines, ["turn"]).collect())) == [("q1", 2, "b"), ("q2", 1, "é\n")]
    todo = spark.createDataFrame([("q1",), ("q3",)], "id string")
    assert [r["id"] for r in files.not_done(todo, lines).collect()] == ["q3"]


def test_manifest(spark, tmp_path):
    path, schema = f"file://{tmp_path}/manifest", "fault string, rows bigint, store string"
    for rows in ([("old", 1, "x")], [("outage", 3, "AFRICA"), ("closure", 2, None)]):
        files.write_manifest(spark.createDataFrame(rows, schema), path)
    assert sorted(r["fault"] for r in files.read_lines(spark, path, schema).collect()) == ["closure", "outage"]


def test_manifest_against_findings(spark):
    from supplylens.operators import manifest

    put = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1"), ("z", "9")], manifest.SCHEMA)
    found = spark.createDataFrame([("x", "1"), ("x", "3"), ("y", "1"), ("w", "5")], manifest.SCHEMA)
    got = {r["fault"]: tuple(r)[1:] for r in manifest.reconciled(put, found).collect()}
    assert got == {"x": (2, 2, 1, 0.5, 0.5), "y": (1, 1, 1, 1.0, 1.0), "z": (1, 0, 0, 0.0, None), "w": (0, 1, 0, None, 0.0)}
