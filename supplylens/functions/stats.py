"""Statistics on small results: plain numbers, not data."""

from __future__ import annotations

import math

import numpy as np


def wape(actual, predicted) -> float:
    """Sum of absolute errors over the sum of actuals; not a number if that is zero."""
    actual, predicted = np.asarray(actual, float), np.asarray(predicted, float)
    total = actual.sum()
    return float(np.abs(actual - predicted).sum() / total) if total else float("nan")


def bootstrap_ci(values: np.ndarray, statistic, rounds: int = 2000, level: float = 0.95, seed: int = 0, strata=None) -> tuple[float, float, float]:
    """(estimate, low, high): rows are drawn anew within each stratum, the interval is by percentiles."""
    values, rng = np.asarray(values), np.random.default_rng(seed)
    groups = [np.arange(len(values))] if strata is None else [np.flatnonzero(np.asarray(strata) == s) for s in np.unique(strata)]
    draws = [statistic(values[np.concatenate([rng.choice(g, len(g)) for g in groups])]) for _ in range(rounds)]
    edge = (1 - level) / 2
    low, high = np.quantile(draws, [edge, 1 - edge])
    return float(statistic(values)), float(low), float(high)


def mcnemar_exact(only_a: int, only_b: int) -> float:
    """Two-sided exact p of a fair coin for the pairs on which two systems differ."""
    n, k = only_a + only_b, min(only_a, only_b)
    if 2 * k == n:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(k + 1)) / 2**n if n <= SUMMED else half_beta(n - k, k + 1)
    return min(1.0, 2 * tail)


#: Pairs whose binomials are added up; beyond, the incomplete beta function takes their place.
SUMMED = 1000


def half_beta(a: float, b: float) -> float:
    """The regularised incomplete beta function at one half, for a > b: a continued fraction by the modified
    method of Lentz, whose length grows with the square root of a."""
    tiny, x = 1e-300, 0.5
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100 + 10 * math.isqrt(int(a + b))):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return value / a * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - (a + b) * math.log(2))
