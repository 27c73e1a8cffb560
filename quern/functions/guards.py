"""Column helpers that stay defined where plain arithmetic would raise or give NaN."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def protected_div(left: Column, right: Column, eps: float = 1e-6) -> Column:
    """``left / right`` with a denominator of at least ``eps`` in size; 0 counts as positive."""
    small = F.when(right >= 0, F.lit(eps)).otherwise(F.lit(-eps))
    return left / F.when(F.abs(right) < eps, small).otherwise(right)


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def finite(value: Column) -> Column:
    """Null where ``value`` is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def safe_corr(a: Column, b: Column, tiny: float = 1e-12) -> Column:
    """Pearson correlation as an aggregate; 0 for no rows or no variance."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.coalesce(F.when((sa > tiny) & (sb > tiny), F.try_divide(F.covar_pop(a, b), sa * sb)), F.lit(0.0))


def average_rank(value: Column, *partition: str) -> Column:
    """Rank by ``value`` within ``partition``, ties sharing the mean of their places."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / 2


def sigmoid(value: Column, bound: float = 60.0) -> Column:
    return 1 / (1 + F.exp(-clip(value, -bound, bound)))
