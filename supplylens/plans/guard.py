"""A guard for ad-hoc SQL, on the plan that Spark's own parser makes.

One query, over views of the allowed schema or common table expressions, with functions from a list
of those that neither read files nor run code. The plan is walked as JSON, since subqueries stand in
expressions and not among a node's children.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession


class Rejected(ValueError):
    """The statement isn't an allowed query."""


# Functions of numbers, text, dates, lists and groups of rows; none reads files, runs code or tells of the session.
ALLOWED = frozenset(
    """abs acos any any_value approx_count_distinct approx_percentile array array_agg array_contains array_distinct array_join array_max array_min
    array_sort ascii asin atan avg bool_and bool_or bround btrim cast cbrt ceil ceiling char_length coalesce collect_list collect_set concat concat_ws
    contains corr cos count count_if covar_pop covar_samp cume_dist date date_add date_diff date_format date_part date_sub date_trunc dateadd
    datediff datepart day dayname dayofmonth dayofweek dayofyear decimal dense_rank double element_at endswith every exp explode extract
    first first_value flatten float floor format_number greatest grouping grouping_id histogram_numeric hour if ifnull ilike in initcap instr int
    isnan isnotnull isnull kurtosis lag last last_day last_value lcase lead least left len length levenshtein like ln locate log log10 log2 lower
    lpad ltrim make_date max max_by mean median min min_by minute mod mode month monthname months_between named_struct negative next_day nth_value
    ntile nullif nullifzero nvl nvl2 percent_rank percentile percentile_approx percentile_cont percentile_disc pmod position positive pow power quarter
    rank regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace regr_slope repeat replace reverse right rint rlike round row_number rpad
    rtrim second sequence sign signum sin size skewness slice some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp
    string struct substr substring substring_index sum tan timestamp timestampdiff to_char to_date to_number to_timestamp transform translate trim trunc try_add
    try_avg try_cast try_divide try_element_at try_multiply try_subtract try_sum try_to_number ucase upper var_pop var_samp variance weekday
    weekofyear width_bucket year zeroifnull""".split()
)
READ_ONLY = frozenset(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit Join UnresolvedHaving SubqueryAlias Distinct Union
    Intersect Except UnresolvedRelation UnresolvedInlineTable OneRowRelation WithWindowDefinition Pivot Unpivot Generate LateralJoin
    UnresolvedSubqueryColumnAliases Offset Window CTERelationDef CTERelationRef WithCTE Tail Expand""".split()
)


def _nodes(tree) -> Iterator[dict]:
    if isinstance(tree, dict):
        if "class" in tree:
            yield tree
        for value in tree.values():
            yield from _nodes(value)
    elif isinstance(tree, list):
        for value in tree:
            yield from _nodes(value)


def _name(node: dict) -> str:
    return node["class"].rpartition(".")[2]


def _names(value) -> list[str]:
    return [x.strip() for x in value.strip("[]").split(",")] if isinstance(value, str) else list(value)


def parse(spark: SparkSession, text: str) -> list:
    """A statement's plan as nested lists of nodes."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:  # the parser's own exceptions come through the bridge
        raise Rejected(f"not a single valid statement: {str(error).splitlines()[0]}") from None
    return json.loads(plan.toJSON())


def check(spark: SparkSession, text: str, schema: str = "core", tables: set[str] | None = None) -> set[str]:
    """Raise Rejected unless the text is one read-only query over allowed tables; returns the tables it reads.

    WITH stands at the start only. A name that it defines is known to the query and to the names
    defined after it; anywhere else it would mean a table of that name.
    """
    plan = parse(spark, text)
    if not plan:
        raise Rejected("empty statement")
    names: set[str] = set()
    used: set[str] = set()
    if _name(plan[0]) == "UnresolvedWith":
        for part in plan[0]["cteRelations"]:
            used |= _check(part["_2"], schema, tables, names)
            names = names | {part["_1"].lower()}
        plan = plan[1:]
    return used | _check(plan, schema, tables, names)


def _check(plan: list, schema: str, tables: set[str] | None, names: set[str]) -> set[str]:
    used: set[str] = set()
    for n in _nodes(plan):
        kind = _name(n)
        if kind == "UnresolvedWith":
            raise Rejected("WITH is allowed at the start only")
        if "plans.logical" in n["class"] and kind not in READ_ONLY or "command" in n["class"].lower():
            raise Rejected(f"only queries are allowed, not {kind}")
        if kind in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
            raise Rejected("table functions are not allowed")
        if kind == "UnresolvedFunction":
            parts = [x.lower() for x in _names(n.get("nameParts", []))]
            if len(parts) != 1 or parts[0] not in ALLOWED:
                raise Rejected(f"function {'.'.join(parts)} is not allowed")
        if kind == "UnresolvedRelation":
            parts = _names(n.get("multipartIdentifier", []))
            if len(parts) == 1 and parts[0].lower() in names:
                continue
            if len(parts) != 2 or parts[0].lower() != schema:
                raise Rejected(f"table {'.'.join(parts)} is not in schema {schema}")
            if tables is not None and parts[1].lower() not in tables:
                raise Rejected(f"no table {'.'.join(parts)}")
            used.add(parts[1].lower())
    return used
