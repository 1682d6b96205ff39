"""Tools by name, with declared arguments: the surface that an adapter would serve."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import functions as F

from supplylens.operators import anomalies, forecast, lookups, reorder, variance
from supplylens.operators.clean import Core
from supplylens.plans.run_sql import MOST_ROWS, SCHEMAS, Result, describe, run_sql
from supplylens.sources.standin import AS_OF

MOST = 50


@dataclass(frozen=True)
class Arg:
    """What a tool takes: a type, the least and the most, or the choices there are."""

    kind: str
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    required: bool = False

    def fault(self, value: Any) -> str | None:
        """What is wrong with a value, in words that go after the argument's name."""
        if self.kind == "choice":
            return None if value in self.choices else f"must be one of {', '.join(self.choices)}"
        if self.kind == "text":
            return None if isinstance(value, str) and value.strip() else "must be text"
        if self.kind == "list":
            return None if isinstance(value, (list, tuple)) and value and all(isinstance(v, str) for v in value) else "must be a list of text"
        if self.kind in ("date", "period"):
            parts = [value] if self.kind == "date" else list(value) if isinstance(value, (list, tuple)) and len(value) == 2 else [None]
            try:
                days = [date.fromisoformat(str(v)) for v in parts]
            except ValueError:
                return "must be a date, YYYY-MM-DD" if self.kind == "date" else "must be a first and a last date, YYYY-MM-DD"
            return "must not end before it begins" if days != sorted(days) else None
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not number or self.kind == "integer" and value != int(value) or not self.low <= value <= self.high:
            return f"must be {'an integer' if self.kind == 'integer' else 'a number'} from {self.low:g} to {self.high:g}"
        return None


@dataclass(frozen=True)
class Tool:
    description: str
    arguments: dict[str, Arg]
    run: Callable[..., Result]


TEXT, LIMIT, SCHEMA = Arg("text"), Arg("integer", 1, MOST), Arg("choice", choices=SCHEMAS)


def _rows(df, limit: int = MOST) -> list[dict[str, Any]]:
    return [r.asDict() for r in df.limit(max(1, min(int(limit), MOST))).collect()]


def _anomalies(core: Core, scope: str = "all", store: str | None = None, dept: str | None = None, limit: int = 20, end: str = AS_OF) -> Result:
    """The stock is known on the as-of date only, so its anomalies are left out for other days."""
    if end > AS_OF:
        raise ValueError(f"end must not be after {AS_OF}: there are no data then")
    parts = {"inventory": lambda: anomalies.inventory_anomalies(core).orderBy("value", ascending=False), "sales": lambda: anomalies.sales_anomalies(core, end).orderBy(F.abs("pct_change").desc(), "store", "subject"), "data_quality": core.issues}
    found, caveats = {}, []
    for name in (k for k in parts if scope in ("all", k)):
        if name == "inventory" and end != AS_OF:
            caveats.append(f"The stock is known on {AS_OF} only; it was not checked.")
            continue
        df = parts[name]()
        df = df.where(F.col("store") == store) if store and "store" in df.columns else df
        if dept and "dept" in df.columns:
            df = df.where(F.col("dept") == dept)
        elif dept and "subject" in df.columns:  # a department or one of its SKUs
            own = core.dim_sku.where(F.col("dept") == dept).select(F.col("sku").alias("subject")).union(core.raw.spark.createDataFrame([(dept,)], "subject string"))
            df = df.join(own, "subject", "left_semi")
        found[name] = _rows(df, limit)
    if "sales" in found:
        caveats += ["A stop in sales can be a stock-out, a delisting or a change of code.", *core.warnings(forecast.shifted(end, -62), end, store)]
    return Result(found, caveats, {"end": end})


def _variance(core: Core, by: str = "dept", a: tuple[str, str] = variance.A, b: tuple[str, str] = variance.B, store: str | None = None, limit: int = 15) -> Result:
    """The largest moves up or down first."""
    key = by if by in ("store", "sku") else "grp"
    x = variance.by_sku(core, by if key == "grp" else "dept", tuple(a), tuple(b))
    out = variance.explain(x.where(F.col("store") == store) if store else x, [key])
    caveats = [w for p in (a, b) for w in core.warnings(*p, store)]
    return Result(_rows(out.orderBy(F.abs("change").desc(), key), limit), caveats, {"a": list(a), "b": list(b)})


def _forecast(core: Core, store: str | None = None, sku: str | None = None, dept: str | None = None, horizon: int = 14) -> Result:
    sku, caveats = lookups.resolve(core.dim_sku, sku) if sku else (None, [])
    by = "sku" if sku else "dept"
    f, wanted = forecast.forecast(core, by), sku or dept
    f = f.where(f.store == store) if store else f
    f = f.where(F.col(by) == wanted) if wanted else f
    keys = ["store", by] if store else [by]
    recent = forecast.history(core, by).where(F.col("date") > F.date_sub(F.lit(forecast.ORIGIN).cast("date"), 28)).groupBy(*keys).agg(F.avg("units").alias("recent_daily_mean"))
    caveats += core.warnings(forecast.shifted(forecast.ORIGIN, -27), forecast.ORIGIN, store)
    return Result(_rows(forecast.window_total(f, keys, int(horizon)).join(recent, keys, "left")), caveats)


def _reorder(core: Core, store: str | None = None, dept: str | None = None, service: float = reorder.SERVICE, review: int = reorder.REVIEW_DAYS, path: str | None = None, skus: list[str] | None = None) -> Result:
    """Lines to order, the costly ones first; with a path the drafts are saved there."""
    caveats, own = ["Drafts wait for a named person; nothing is ordered."], []
    for code in skus or []:
        sku, said = lookups.resolve(core.dim_sku, code)
        own.append(sku)
        caveats += said
    found = reorder.lines(core, store, dept, float(service), int(review), own)
    longest = found.agg(F.max("lead_time_days")).first()[0]
    if longest is None:
        raise ValueError("no active SKU with stock matches")
    if longest + int(review) > forecast.HORIZON:
        raise ValueError(f"lead time and review reach beyond the {forecast.HORIZON} days of the forecast")
    saved = {"batch": reorder.save(core, found, path)} if path else {}
    return Result(_rows(found.where("cases > 0").orderBy(F.desc("cost"), "store", "sku")), caveats, saved)


def _describe(core: Core, schema: str = "core") -> Result:
    """Every column, the issues that cleaning found, and what to mind."""
    tables = [r.asDict() for r in describe(core, schema).collect()]
    if schema == "raw":
        return Result({"tables": tables}, ["These are the exports as they came, faults included."])
    return Result({"tables": tables, "issues": _rows(core.issues())}, ["Store-days with status missing_data have no sales rows."])


TOOLS = {
    "describe_data": Tool("Tables, columns and row counts.", {"schema": SCHEMA}, _describe),
    "run_sql": Tool("One read-only query over the cleaned tables or the exports.", {"text": Arg("text", required=True), "most": Arg("integer", 1, MOST_ROWS), "schema": SCHEMA}, run_sql),
    "detect_anomalies": Tool(
        "Stock, sales and data-quality anomalies.", {"scope": Arg("choice", choices=("all", "inventory", "sales", "data_quality")), "store": TEXT, "dept": TEXT, "limit": LIMIT, "end": Arg("date")}, _anomalies
    ),
    "explain_variance": Tool(
        "A revenue change as volume, mix and price.", {"by": Arg("choice", choices=("dept", "category", "store", "sku")), "a": Arg("period"), "b": Arg("period"), "store": TEXT, "limit": LIMIT}, _variance
    ),
    "forecast_demand": Tool("Demand over the next days with an interval.", {"store": TEXT, "sku": TEXT, "dept": TEXT, "horizon": Arg("integer", 1, forecast.HORIZON)}, _forecast),
    "draft_reorder": Tool(
        "Reorder lines that wait for a named person.", {"store": TEXT, "dept": TEXT, "service": Arg("number", 0.5, 0.995), "review": Arg("integer", 1, 14), "path": TEXT, "skus": Arg("list")}, _reorder
    ),
}


def call(core: Core, name: str, **arguments: Any) -> dict[str, Any]:
    """The tool's envelope, or an error: unknown tools and arguments are turned down by name."""
    tool, began = TOOLS.get(name), time.time()
    if tool is None:
        return {"error": f"unknown tool {name}; there are {', '.join(TOOLS)}"}
    if unknown := set(arguments) - set(tool.arguments):
        return {"error": f"unknown arguments: {', '.join(sorted(unknown))}"}
    if missing := {k for k, a in tool.arguments.items() if a.required} - set(arguments):
        return {"error": f"missing arguments: {', '.join(sorted(missing))}"}
    arguments = {k: v for k, v in arguments.items() if v is not None}
    if faults := [f"{k} {fault}" for k, v in arguments.items() if (fault := tool.arguments[k].fault(v))]:
        return {"error": "; ".join(faults)}
    try:
        result = tool.run(core, **arguments)
    except (ValueError, RuntimeError) as error:
        return {"error": str(error)}
    return {"data": result.data, "caveats": result.caveats, "provenance": {**result.provenance, "tool": name, "total_seconds": round(time.time() - began, 3)}}
