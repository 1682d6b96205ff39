"""Traces of turns: what was asked, the tool calls with what they took, costs and latency.

A trace is a row whose steps are JSON text, an array of calls. Traces are appended as JSON lines; a query parses
the steps with a stated schema and reads only the fields that it uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded
from supplylens.sources import files
from supplylens.sources.standin import Raw

TOOLS = ("describe_data", "run_sql", "detect_anomalies", "explain_variance", "forecast_demand", "draft_reorder")
SCHEMA = "conversation_id long, turn long, question string, answer string, tool_calls long, steps string, usage string, cost_usd double, latency_s double"
STEPS, USAGE = "array<struct<tool: string, ms: long, is_error: boolean>>", "struct<input: long, output: long>"
IN_PRICE, OUT_PRICE = 3, 15  # dollars a million units


def trace(question: Column, answer: Column, steps: Column, spent: Column) -> list[Column]:
    """The columns of a trace; steps: an array of (tool, ms, is_error); spent: (input, output)."""
    cost = (spent["input"] * IN_PRICE + spent["output"] * OUT_PRICE) / F.lit(1e6)
    ms = F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s["ms"])
    return [
        question.alias("question"), answer.alias("answer"), F.size(steps).cast("long").alias("tool_calls"), F.to_json(steps).alias("steps"), F.to_json(spent).alias("usage"),
        rounded(cost, 6).alias("cost_usd"), rounded(ms / F.lit(1000.0) + 0.5, 3).alias("latency_s"),
    ]


def stand_in(raw: Raw) -> DataFrame:
    """A trace for each user turn of the conversations; calls follow from the numbers of conversation and turn."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    x = raw.table("conversations").withColumn("answer", F.lead("text").over(w)).where("role = 'user'")
    n = (F.col("conv_id") + F.col("turn")) % 4
    number = lambda a, b, c, k, m: (F.col("conv_id") * a + F.col("turn") * b + k * c) % m
    names = F.array(*(F.lit(t) for t in TOOLS))
    step = lambda k: F.struct(F.get(names, number(7, 3, 1, k, 6).cast("int")).alias("tool"), (20 + number(13, 7, 11, k, 400)).alias("ms"), (number(1, 1, 1, k, 9) == 0).alias("is_error"))
    steps = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), step)).otherwise(F.array().cast(STEPS))
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))).cast("long")
    x = x.select(F.col("conv_id").alias("conversation_id"), "turn", F.col("text").alias("q"), F.col("answer").alias("a"), steps.alias("s"), F.struct(size("text").alias("input"), size("answer").alias("output")).alias("u"))
    return x.select("conversation_id", "turn", *trace(F.col("q"), F.col("a"), F.col("s"), F.col("u")))


def recorded(raw: Raw) -> DataFrame:
    """The traces, read back from their lines."""
    path = raw.store.file("traces.jsonl", lambda p: files.append_lines(stand_in(raw), p))
    return files.read_lines(raw.spark, path, SCHEMA)


def by_tool(traces: DataFrame) -> DataFrame:
    """Calls, errors and times of each tool."""
    x = traces.select(F.explode(F.from_json("steps", STEPS)).alias("s")).select("s.*")
    p = lambda q: rounded(F.percentile("ms", q), 3)
    return x.groupBy("tool").agg(F.count("*").alias("calls"), F.count(F.when(F.col("is_error"), 1)).alias("errors"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"))


def by_turn(traces: DataFrame) -> DataFrame:
    """Of each turn number: turns, calls, output, cost and latency."""
    u = F.from_json("usage", USAGE)
    p = lambda q: rounded(F.percentile("latency_s", q), 3)
    return traces.groupBy("turn").agg(
        F.count("*").alias("turns"), F.sum("tool_calls").alias("tool_calls"), F.sum(u["output"]).alias("output"), rounded(F.sum("cost_usd"), 4).alias("cost_usd"), p(0.5).alias("p50_s"), p(0.95).alias("p95_s")
    )
