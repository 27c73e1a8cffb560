"""Exact quantiles over a whole table without a task that sees all values.

Values are counted (a partial aggregate), range-partitioned and numbered by running counts; each
quantile is interpolated between the values at its two neighbouring places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.metrics import running


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """One row with the array ``q`` of the quantiles of ``value``, linear between places; nulls don't count.

    Without any value the row's entries are null.
    """
    counts = df.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    placed = running(counts, "v", {"upto": "c"})
    total = placed.agg(F.max("upto").alias("n")).first()["n"] or 0

    def at(place: int) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("v")))

    parts = []
    for share in shares:
        exact = share * max(total - 1, 0)
        low = int(exact)
        step = exact - low
        parts.append(at(low) if step == 0 else at(low) * (1 - step) + at(low + 1) * step)
    return placed.agg(F.array(*parts).alias("q"))
