from pyspark.sql import functions as F

from supplylens.operators import traces
from supplylens.sources import files


def test_traces_are_recorded_and_read_by_path(spark, tmp_path):
    rows = [(1, 0, "how many?", 'seven "7"\n', [("run_sql", 40, False), ("run_sql", 60, True)], (9, 8)), (1, 1, "é?", None, [], (2, 0)), (2, 0, None, "x", [("draft_reorder", 100, False)], (0, 1))]
    df = spark.createDataFrame(rows, f"conversation_id long, turn long, q string, a string, s {traces.STEPS}, u {traces.USAGE}")
    path = f"file://{tmp_path}/t"
    for turn in (0, 1):  # appended as they come
        files.append_lines(df.where(F.col("turn") == turn).select("conversation_id", "turn", *traces.trace(F.col("q"), F.col("a"), F.col("s"), F.col("u"))), path)
    got = files.read_lines(spark, path, traces.SCHEMA)
    back = {(r["conversation_id"], r["turn"]): r for r in got.collect()}
    assert back[1, 0]["answer"] == 'seven "7"\n' and back[1, 0]["tool_calls"] == 2 and back[1, 0]["latency_s"] == 0.6 and back[1, 0]["cost_usd"] == 0.000147
    assert back[1, 1]["answer"] is None and back[1, 1]["steps"] == "[]" and back[1, 1]["latency_s"] == 0.5
    assert {r["tool"]: tuple(r)[1:] for r in traces.by_tool(got).collect()} == {"run_sql": (2, 1, 50.0, 59.0), "draft_reorder": (1, 0, 100.0, 100.0)}
    assert {r["turn"]: (r["turns"], r["tool_calls"], r["output"]) for r in traces.by_turn(got).collect()} == {0: (2, 3, 9), 1: (1, 0, 0)}
