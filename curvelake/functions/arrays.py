"""Sums and neighbours in sorted arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = float("-inf")


def log_or_never(x: Column) -> Column:
    """ln x, -inf for x <= 0: ln(0) would be null, and an average would pass over it."""
    return F.when(x <= 0, F.lit(NEVER)).otherwise(F.ln(F.when(x > 0, x)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def at(x: Column, i: Column) -> Column:
    """x[i], one-based, i held inside the array."""
    return F.element_at(x, F.greatest(F.lit(1), F.least(i, F.size(x))).cast("int"))


def over(first: Column, last: Column, f: Callable[[Column], Column]) -> Column:
    """f(i) for i from first to last, empty where last < first."""
    return F.transform(F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>")), f)
