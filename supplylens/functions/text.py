"""String similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplylens.functions.numbers import rounded

# A common prefix of up to four characters lifts what is above 0.7 already.
PREFIX, LIFT, LIFTED_FROM = 4, 0.1, 0.7


def close_codes(df: DataFrame, column: str, wanted: str, k: int) -> DataFrame:
    """The k codes most similar to a wanted one, ties by code: each task keeps its k best, then these are merged."""
    x = df.select(column, rounded(jaro_winkler_column(F.col(column), wanted), 9).alias("similarity"))
    return x.where("similarity IS NOT NULL").orderBy(F.desc("similarity"), column).limit(k)


def normal_code(code: Column) -> Column:
    """A code as people spell it, in the form of the master table."""
    return F.translate(F.upper(F.trim(code)), "- ", "__")


def jaro_winkler(a: str, b: str, weight: float = LIFT, most: int = PREFIX) -> float:
    """Similarity from 0 to 1 by matching characters near each other, raised by a common prefix."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    m, moved = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= LIFTED_FROM:
        return jaro
    prefix = 0
    for x, y in zip(a[:most], b[:most], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro)


def jaro_winkler_column(column: Column, wanted: str) -> Column:
    """The same in built-in functions over the characters of the column; the wanted string is a constant.

    For each character of the wanted string in turn the first free place within reach is taken; `places` holds the
    taken ones in that order, and sorted they are the column's own order.
    """
    if not wanted:
        return F.when(column == "", 1.0).when(column != "", 0.0)
    n, none = len(wanted), F.array().cast("array<int>")
    own = F.array(*(F.lit(c) for c in wanted))

    def score(chars: Column) -> Column:
        size = F.size(chars)
        reach = F.greatest(F.floor(F.greatest(F.lit(n), size) / 2) - 1, F.lit(0)).cast("int")

        def take(places: Column, i: Column) -> Column:
            low, high = F.greatest(i - reach, F.lit(0)), F.least(i + reach, size - 1)
            window = F.when(low <= high, F.sequence(low, high)).otherwise(none)
            free = F.filter(window, lambda j: (F.get(chars, j) == F.get(own, i)) & ~F.array_contains(places, j))
            return F.when(F.size(free) > 0, F.array_append(places, F.get(free, F.lit(0)))).otherwise(places)

        places = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), none, take)
        prefix = sum((F.when(F.slice(chars, 1, k) == F.slice(own, 1, k), 1).otherwise(0) for k in range(2, min(PREFIX, n) + 1)), F.when(F.get(chars, F.lit(0)) == wanted[0], 1).otherwise(0))

        def similarity(p: Column) -> Column:
            m = F.size(p).cast("double")
            moved = F.size(F.filter(F.zip_with(p, F.sort_array(p), lambda x, y: F.get(chars, x) != F.get(chars, y)), lambda differs: differs))
            jaro = (m / n + m / size + (m - F.floor(moved / 2)) / m) / 3
            lifted = F.transform(F.array(jaro), lambda v: F.when(v > LIFTED_FROM, v + prefix * LIFT * (1 - v)).otherwise(v))
            return F.when(m > 0, F.get(lifted, F.lit(0))).otherwise(0.0)

        return F.get(F.transform(F.array(places), similarity), F.lit(0))

    # Names for values that are used many times, bound by lambdas.
    return F.when(column == "", 0.0).when(column == wanted, 1.0).when(column.isNotNull(), F.get(F.transform(F.array(F.split(column, "")), score), F.lit(0)))
