import pytest

from supplylens.sources import checked
from supplylens.sources.checked import Constraints, Violation

SCHEMA = "draft_id string, status string, store string"
RULES = Constraints(key=("draft_id",), required=("store",), domains={"status": ("PENDING", "APPROVED")})


def test_bad_rows_are_refused_and_nothing_is_seen(spark, tmp_path):
    path = f"file://{tmp_path}/drafts"
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    checked.append(make(("a", "PENDING", "x"), ("b", "APPROVED", "x")), path, RULES)
    for rows, said in (
        ([("c", "PENDING", "x"), ("c", "PENDING", "y")], "draft_id is there twice"), ([("a", "PENDING", "x")], "draft_id is there twice"), ([("d", "SENT", "x")], "status is none of"),
        ([("e", "PENDING", None)], "store is null"), ([(None, "PENDING", "x")], "draft_id is null"), ([("f", "PENDING", "x"), ("g", "GONE", None)], "1 x store is null; 1 x status"),
    ):
        with pytest.raises(Violation, match=said):
            checked.append(make(*rows), path, RULES)
        assert sorted(r["draft_id"] for r in spark.read.parquet(path).collect()) == ["a", "b"]
    checked.append(make(("c", None, "x")), path, RULES)
    assert spark.read.parquet(path).count() == 3 and not list((tmp_path / "drafts").glob("_staged*"))


def test_references_and_waiting_rows(spark, tmp_path):
    path, heads = f"file://{tmp_path}/lines", spark.createDataFrame([("a", "PENDING", "x")], SCHEMA)
    rules = Constraints(references={"draft_id": (heads, "draft_id")})
    with pytest.raises(Violation, match="1 x draft_id is not there"):
        checked.append(spark.createDataFrame([("a", 1), ("z", 2)], "draft_id string, n int"), path, rules)
    waiting = checked.Staged(spark.createDataFrame([("a", 1), ("a", 1)], "draft_id string, n int"), path, rules)
    assert checked.existing(spark, path) is None
    batch = waiting.commit()
    assert spark.read.parquet(path).where(f"batch = '{batch}'").count() == 2
