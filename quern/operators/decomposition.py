"""A seasonal decomposition as a fitted component, and the alignment of a history with exogenous rows.

The fitted state is a table of phases by series; later rows are joined to it, so a new batch is decomposed without the
rows of the fit. ``timeseries.decompose`` is the same on the rows of the fit themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.timeseries import decompose
from quern.runtime import materialize


class SeasonalDecomposition:
    """State: by series and phase, the seasonal part; how many rows were seen; the last trend and its mean slope.

    New rows follow those of the fit in order: phases go on where they ended, the trend goes on from its last value by its mean step.
    Series that the fit doesn't know, or that were shorter than two periods, have no parts (null).
    """

    def __init__(self, y: str, order: str, by: list[str], period: int, trend_window: int | None = None):
        if period < 2:
            raise ValueError("a period has two rows at least")
        self.y, self.order, self.by, self.period, self.trend_window = y, order, by, period, trend_window
        self.state: DataFrame | None = None

    def fit(self, df: DataFrame) -> SeasonalDecomposition:
        parts = decompose(df, self.y, self.order, self.by, self.period, self.trend_window)
        rows = parts.withColumn("_at", F.row_number().over(Window.partitionBy(*self.by).orderBy(self.order)))
        phase = F.pmod(F.col("_at") - 1, F.lit(self.period)).alias("phase")
        seasonal = rows.groupBy(*self.by, phase).agg(F.first("seasonal").alias("seasonal"))
        ends = rows.groupBy(*self.by).agg(F.count("*").alias("n"), F.min_by("trend", "_at").alias("_t0"), F.max_by("trend", "_at").alias("trend_end"))
        ends = ends.withColumn("slope", (F.col("trend_end") - F.col("_t0")) / (F.col("n") - 1)).drop("_t0")
        self.state = materialize(_on(seasonal, ends, self.by), "decomposition-state")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """trend, seasonal and resid of rows that come after those of the fit."""
        if self.state is None:
            raise ValueError("fit comes first")
        n = self.state.groupBy(*self.by).agg(F.first("n").alias("_n"))
        rows = df.withColumn("_k", F.row_number().over(Window.partitionBy(*self.by).orderBy(self.order)))
        rows = _on(rows, n, self.by, "left").withColumn("phase", F.pmod(F.col("_n") + F.col("_k") - 1, F.lit(self.period)).cast("int"))
        state = self.state.withColumn("phase", F.col("phase").cast("int"))
        rows = rows.join(state, [*self.by, "phase"], "left")
        trend = F.col("trend_end") + F.col("slope") * F.col("_k")
        out = rows.withColumn("trend", trend)
        return out.select(*df.columns, "trend", "seasonal", (F.col(self.y) - F.col("trend") - F.col("seasonal")).alias("resid"))


def _on(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    return a.join(b, by, how) if by else a.join(F.broadcast(b), F.lit(True), how)


def align_history(history: DataFrame, known: DataFrame, y: str, order: str, by: list[str], exogenous: list[str], tolerance: float = 1e-12) -> DataFrame:
    """``history`` with the exogenous columns of the rows of ``known`` at the same places, and how its series stands to the known one.

    ``match``: ``prefix`` if the history's values are the first ones of the known series; ``length`` if they aren't, but both are as
    long, so places still agree; else ``none``, and the exogenous columns are null. Places are counted in order within a series; a null value
    is equal to nothing.
    """
    w = Window.partitionBy(*by).orderBy(order)
    place = F.row_number().over(w).alias("_at")
    left = history.select("*", place)
    right = known.select(*by, F.col(y).cast("double").alias("_y"), *(F.col(c).alias(f"_x_{c}") for c in exogenous), place)
    both = left.join(right, [*by, "_at"], "left")
    same = F.coalesce(F.abs(F.col(y).cast("double") - F.col("_y")) <= tolerance, F.lit(False))
    sizes = known.groupBy(*by).agg(F.count("*").alias("_known"))
    verdict = both.groupBy(*by).agg(F.count("*").alias("_n"), F.count(F.when(same, 1)).alias("_same"))
    verdict = _on(verdict, sizes, by, "left")
    match: Column = F.when(F.col("_same") == F.col("_n"), "prefix").when(F.col("_n") == F.col("_known"), "length").otherwise("none")
    out = _on(both, verdict.select(*by, match.alias("match")), by)
    return out.select(*history.columns, *(F.when(F.col("match") != "none", F.col(f"_x_{c}")).alias(c) for c in exogenous), "match")
