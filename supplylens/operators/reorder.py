"""Reorder lines, drafts and their decisions."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timezone
from statistics import NormalDist

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded
from supplylens.operators.clean import Core
from supplylens.operators.forecast import HORIZON, ORIGIN, Z90, order_repair, profiles
from supplylens.sources.checked import Constraints, Staged
from supplylens.sources.standin import Raw

SERVICE, REVIEW_DAYS = 0.95, 7


DECISION = "decision_id string, draft_id string, decided_at timestamp_ntz, status string, by string, note string"


def cases(need: Column, pack: Column) -> Column:
    """Whole cases; a need that is met exactly takes no more."""
    return F.ceil(F.greatest(need, F.lit(0.0)) / pack - F.lit(1e-9)).cast("long")


def lines(core: Core, store: str | None = None, dept: str | None = None, service: float = SERVICE, review: int = REVIEW_DAYS, skus: list[str] | None = None) -> DataFrame:
    """Cases to order for each store and active SKU: demand until the next delivery but one, plus safety
    stock from the upper tail, less what is there and on its way. Packs and costs are the SKU's, lead times
    its supplier's."""
    items = core.dim_sku.where("status = 'ACTIVE'").select("sku", "dept", "case_pack", "unit_cost", "supplier_id")
    items = items.join(core.raw.suppliers(), "supplier_id")
    stock = core.inventory.join(items.where(F.col("dept") == dept) if dept else items, "sku")
    stock = stock.where(F.col("store") == store) if store else stock
    stock = stock.where(F.col("sku").isin(skus)) if skus else stock
    # Days ahead differ by weekday only: the first day of each is one of the first seven, and the others come every week.
    n = F.least(F.col("lead_time_days") + review, F.lit(HORIZON))
    p, demand, variance = profiles(core), F.lit(0.0), F.lit(0.0)
    for k in range(7):
        first = (k - date.fromisoformat(ORIGIN).weekday() - 1) % 7 + 1
        days = F.floor((n - first + 7) / 7)
        _, mean, p90 = order_repair(F.col("q10"), F.col(f"m{k}"), F.col("q90"))
        sigma = F.greatest(rounded(p90, 6) - mean, F.lit(0.0)) / Z90
        demand, variance = demand + days * mean, variance + days * sigma * sigma
    z = NormalDist().inv_cdf(service)
    x = stock.join(p.drop("sales", "ahead", "flat").hint("merge"), ["store", "sku"]).withColumns({"demand": demand, "safety": F.lit(z) * F.sqrt(variance)})
    need = F.col("demand") + F.col("safety") - F.col("on_hand") - F.col("on_order")
    x = x.withColumn("cases", cases(need, F.col("case_pack").cast("double")))
    return x.select(
        "store", "sku", "dept", "supplier_id", "lead_time_days", "min_order_cases", "case_pack", rounded(F.col("demand"), 4).alias("demand"), rounded(F.col("safety"), 4).alias("safety"),
        "on_hand", "on_order", "cases", rounded(F.col("cases") * F.col("case_pack") * F.col("unit_cost")).alias("cost"),
    )


def drafts(found: DataFrame) -> DataFrame:
    """One draft for each store and supplier; those below the supplier's minimum are flagged, not raised."""
    x = found.where("cases > 0").groupBy("store", "supplier_id", "lead_time_days", "min_order_cases").agg(F.count("*").alias("n_lines"), F.sum("cases").alias("cases"), rounded(F.sum("cost")).alias("cost"))
    return x.select("store", "supplier_id", "lead_time_days", "n_lines", "cases", "cost", (F.col("cases") < F.col("min_order_cases")).alias("below_minimum"), F.lit("PENDING_APPROVAL").alias("status"))


STATES = ("PENDING_APPROVAL", "APPROVED", "REJECTED")


def save(core: Core, found: DataFrame, path: str) -> str:
    """Append drafts and their lines under a new id. Both are written and checked before either is seen, lines first:
    readers join lines to headers, so lines of a save that failed are never seen. Returns the id."""
    batch = uuid.uuid4().hex
    key = F.concat(F.lit(f"{batch}-"), "store", F.lit("-"), F.col("supplier_id").cast("string"))
    rows = core.raw.store.table(f"lines_{batch}", lambda: found)
    headers = core.raw.store.table(f"drafts_{batch}", lambda: drafts(rows).withColumn("draft_id", key))
    heads = Staged(headers, f"{path}/drafts", Constraints(key=("draft_id",), required=("store", "supplier_id"), domains={"status": STATES}))
    try:
        lines_ = Staged(rows.where("cases > 0").withColumn("draft_id", key), f"{path}/lines", Constraints(key=("draft_id", "sku"), references={"draft_id": (headers, "draft_id")}))
    except Exception:
        heads.discard()
        raise
    lines_.commit()
    heads.commit()
    return batch


def listing(spark, path: str, store: str | None = None, status: str | None = None) -> DataFrame:
    """Drafts with their state, the costly ones first."""
    headers = spark.read.parquet(f"{path}/drafts")
    headers = headers.where(F.col("store") == store) if store else headers
    try:
        decided = spark.read.parquet(f"{path}/decisions")
    except AnalysisException:
        decided = spark.createDataFrame([], DECISION)
    state = fold(headers.select("draft_id", "store"), decided).select("draft_id", F.col("status").alias("state"), "decided_by")
    out = headers.join(state, "draft_id").withColumn("status", F.col("state")).drop("state")
    return (out.where(F.col("status") == status) if status else out).orderBy(F.desc("cost"), "draft_id")


def decide(spark, path: str, draft_id: str, status: str, by: str, note: str = "") -> None:
    """Append a decision; only a named person decides, and a rejection says why."""
    if status not in ("APPROVED", "REJECTED") or not by.strip() or status == "REJECTED" and not note.strip():
        raise ValueError("a decision is APPROVED or REJECTED by a named person, a rejection with a note")
    state = listing(spark, path).where(F.col("draft_id") == draft_id).first()
    if state is None or state["status"] != "PENDING_APPROVAL":
        raise ValueError(f"no pending draft {draft_id}")
    row = [(uuid.uuid4().hex, draft_id, datetime.now(timezone.utc).replace(tzinfo=None), status, by, note)]
    spark.createDataFrame(row, DECISION).write.mode("append").parquet(f"{path}/decisions")


def fold(headers: DataFrame, decisions: DataFrame) -> DataFrame:
    """The state of append-only drafts: the earliest valid decision stands, the rest are ignored.

    A decision is valid with a named person, and a rejection with a note. Only valid transitions of
    pending drafts count, so later ones can't change a state.
    """
    valid = decisions.where(F.col("status").isin("APPROVED", "REJECTED") & (F.trim("by") != "") & ((F.col("status") == "APPROVED") | (F.coalesce(F.trim("note"), F.lit("")) != "")))
    first = valid.groupBy("draft_id").agg(F.min_by(F.struct("status", "by"), F.struct("decided_at", "decision_id")).alias("d"))
    return headers.join(first, "draft_id", "left").select("draft_id", "store", F.coalesce("d.status", F.lit("PENDING_APPROVAL")).alias("status"), F.col("d.by").alias("decided_by"))


def stand_in_decisions(raw: Raw) -> tuple[DataFrame, DataFrame]:
    """Every order is a draft; the events' decisions spread over all order keys by a prime step, three to a draft."""
    orders = raw.table("orders")
    headers = orders.select(F.col("o_orderkey").alias("draft_id"), F.col("o_orderpriority").alias("store"))
    last = F.broadcast(orders.agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")))  # one row
    e = raw.table("events").where("event_type IN ('click', 'error', 'purchase')")
    status = F.when(F.col("event_type") == "error", "REJECTED").otherwise("APPROVED")
    by = F.when(F.col("user_id") % 5 == 0, " ").otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string")))
    note = F.when(F.col("value") > 50, "too much")
    draft = F.col("low") + F.expr("event_id div 3") * 7919 % (F.col("high") - F.col("low") + 1)
    return headers, e.crossJoin(last).select(F.col("event_id").alias("decision_id"), draft.alias("draft_id"), F.col("ts").alias("decided_at"), status.alias("status"), by.alias("by"), note.alias("note"))
