"""Arithmetic that gives the same doubles in every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 2) -> Column:
    """Half up by plain double arithmetic: round() works on decimal strings and differs elsewhere."""
    scale = F.lit(float(10**places))
    return F.floor(x * scale + F.lit(0.5)) / scale


def money(x: Column) -> Column:
    """A sum of cents: exact in any order, given as a double."""
    return F.sum(F.round(x * 100).cast("long")) / F.lit(100.0)


def long(x: Column) -> Column:
    return x.cast("long")
