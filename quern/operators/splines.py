"""Additive models of B-splines with a ridge penalty, cross-validated in one pass.

Basis functions on equal steps are closed forms of a column: generated code in the JVM where they are the result, arrays in tasks where they are summed. Every fold's sums of products
come from one pass over the rows; the fit without a fold is the total's sums less that fold's, so each penalty
and each fold is a small solve and no second look at the data. Only folds x k x k sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.moments import MOST_COLUMNS

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
#: A feature with as many values at most (to three digits) is taken as it is.
FEW_VALUES = 3


@dataclass
class Spline:
    """A feature's basis: ``knots`` from low to high at equal steps; beyond them the column is clipped. The last function is left out."""

    name: str
    low: float
    high: float
    knots: int
    degree: int = 3

    @property
    def size(self) -> int:
        return self.knots + self.degree - 2

    def columns(self, x: Column) -> list[Column]:
        step = (self.high - self.low) / (self.knots - 1)
        at = (F.least(F.greatest(x.cast("double"), F.lit(self.low)), F.lit(self.high)) - self.low) / step + self.degree
        return [self._bump(at - j) for j in range(self.size)]

    def _bump(self, u: Column) -> Column:
        """The basis function that lives on 0 .. degree + 1."""
        n = self.degree
        total = F.lit(0.0)
        for i in range(n + 1):
            term = F.pow(F.greatest(u - i, F.lit(0.0)), F.lit(n)) * ((-1) ** i * comb(n + 1, i) / factorial(n))
            total = total + term
        return F.when((u > 0) & (u < n + 1), total).otherwise(F.lit(0.0))

    def values(self, x: np.ndarray) -> np.ndarray:
        at = (np.clip(x, self.low, self.high) - self.low) / ((self.high - self.low) / (self.knots - 1)) + self.degree
        n, places = self.degree, self.size + self.degree + 1
        # Every function is a sum of a few of the same truncated powers, so these are worked out once for all of them.
        over = np.maximum(at[:, None] - np.arange(places), 0.0)
        powers = (over > 0).astype(float)
        for _ in range(n):
            powers *= over
        weights = np.zeros((places, self.size))
        for j in range(self.size):
            for i in range(n + 2):
                weights[j + i, j] = (-1) ** i * comb(n + 1, i) / factorial(n)
        out = powers @ weights
        return out


def plan(df: DataFrame, features: list[str], knots: int = 8, degree: int = 3) -> dict[str, Spline | None]:
    """The spline of each feature; None for those with few values. One aggregate."""
    stats = df.agg(*(a for f in features for a in (F.min(f).cast("double").alias(f"a_{f}"), F.max(f).cast("double").alias(f"b_{f}"), F.approx_count_distinct(F.round(F.col(f).cast("double"), 3), 0.01).alias(f"n_{f}")))).first()
    out: dict[str, Spline | None] = {}
    for f in features:
        low, high, n = stats[f"a_{f}"], stats[f"b_{f}"], stats[f"n_{f}"]
        out[f] = None if low is None or n <= FEW_VALUES or high <= low else Spline(f, low, high, min(knots, max(3, n // 5)), degree)
    return out


@dataclass
class Sums:
    """n, sums and products (last column: the target) of a set of rows."""

    n: float
    x: np.ndarray
    xx: np.ndarray

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.x - other.x, self.xx - other.xx)

    def ridge(self, alpha: float) -> np.ndarray:
        """Intercept and coefficients; the intercept carries no penalty."""
        mean = self.x / self.n
        centred = self.xx - self.n * np.outer(mean, mean)
        k = len(mean) - 1
        w = np.linalg.lstsq(centred[:k, :k] + alpha * np.eye(k), centred[:k, k], rcond=None)[0]
        return np.concatenate([[mean[k] - mean[:k] @ w], w])

    def squares(self, w: np.ndarray) -> float:
        """Sum of squared errors of a fit on these rows."""
        k = len(w) - 1
        v = np.concatenate([-w[1:], [1.0]])
        return float(v @ self.xx @ v - 2 * w[0] * (v @ self.x) + self.n * w[0] ** 2)


def fold_sums(df: DataFrame, columns: list[Column], target: Column, fold: Column, bases: list[Spline | None] | None = None) -> dict[int, Sums]:
    """Sums of each fold (a whole number), in one pass; rows that miss a value go.

    With ``bases``, one for each column, the columns are followed by each one's basis functions (by itself, if None). Tasks work
    these out from the column, so that no more than it goes to Python.
    """
    added = sum(1 if s is None else s.size for s in bases or [])
    k, given = len(columns) + added + 1, len(columns) + 1
    if k > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    names = [f"c{i}" for i in range(given)]
    rows = df.select(fold.cast("int").alias("fold"), *(c.cast("double").alias(n) for c, n in zip([*columns, target], names, strict=True))).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy()
            *own, target = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            x = np.column_stack([np.ones(len(fold)), *own, *(c if s is None else s.values(c) for c, s in zip(own, bases or [], strict=False)), target])
            for f in np.unique(fold).tolist():
                part = x[fold == f]
                found[f] = found.get(f, 0) + part.T @ part
        for f, s in found.items():
            i, j = (a.ravel() for a in np.indices(s.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(i.size, f)), pa.array(i), pa.array(j), pa.array(s.ravel())], names=["fold", "i", "j", "s"])

    out: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(run, "fold long, i long, j long, s double").groupBy("fold", "i", "j").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r.fold, np.zeros((k + 1, k + 1)))[r.i, r.j] = r.s
    return {f: Sums(s[0, 0], s[0, 1:], s[1:, 1:]) for f, s in sorted(out.items())}


def cross_validate(folds: dict[int, Sums], alphas: tuple[float, ...] = ALPHAS) -> tuple[float, dict[float, float], np.ndarray]:
    """The best alpha (the smallest of equal ones), the mean squared error left out of each, and the fit of all rows."""
    if len(folds) < 2:
        raise ValueError("cross-validation needs two folds")
    parts = list(folds.values())
    total = Sums(sum(s.n for s in parts), sum(s.x for s in parts), sum(s.xx for s in parts))
    error = {a: sum(s.squares((total - s).ridge(a)) for s in parts) / total.n for a in alphas}
    best = min(error, key=lambda a: (error[a], a))
    return best, error, total.ridge(best)


def linearity(df: DataFrame, features: list[str], target: Column, fold: Column, knots: int = 8, degree: int = 3, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """For each feature: kind, the linear model's coefficient, the spans of its line and curve, and whether the curve departs from the line.

    It does if its span is over 1.5 times the line's, or its correlation with the line at 100 points is below 0.8. Each row also
    has the chosen alpha and both models' root mean squared errors. Features enter by their standardised values.
    """
    stats = df.agg(*(a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")))).first()
    scaled = {f: (F.col(f) - (stats[f"m_{f}"] or 0.0)) / (stats[f"s_{f}"] or 1.0) for f in features}
    rows = df.select(*(c.alias(f) for f, c in scaled.items()), target.cast("double").alias("_t"), fold.cast("int").alias("_f"))
    splines = plan(rows, features, knots, degree)
    at: dict[str, int] = {}
    k = 0
    for f, s in splines.items():
        at[f] = k
        k += 1 if s is None else s.size
    folds = fold_sums(rows, [F.col(f) for f in features], F.col("_t"), F.col("_f"), [splines[f] for f in features])
    pick = lambda keep: {f: Sums(s.n, s.x[keep], s.xx[np.ix_(keep, keep)]) for f, s in folds.items()}
    m = len(features)
    straight, curved = pick([*range(m), m + k]), pick([*range(m, m + k), m + k])
    alpha, _, w = cross_validate(curved, alphas)
    total = lambda parts: Sums(sum(s.n for s in parts.values()), sum(s.x for s in parts.values()), sum(s.xx for s in parts.values()))
    line = total(straight).ridge(0.0)
    rmse = [float(np.sqrt(max(total(p).squares(v), 0.0) / total(p).n)) for p, v in ((straight, line), (curved, w))]
    out = []
    for i, f in enumerate(features):
        slope, s = float(line[i + 1]), splines[f]
        if s is None:
            out.append((f, "few values", slope, None, None, False, alpha, *rmse))
            continue
        x = np.linspace(s.low, s.high, 100)
        curve, flat = s.values(x) @ w[1 + at[f] : 1 + at[f] + s.size], x * slope
        span, width = float(np.ptp(curve)), abs(s.high - s.low) * abs(slope)
        apart = span > 1.5 * width or (np.ptp(flat) > 0 and span > 0 and float(np.corrcoef(flat, curve)[0, 1]) < 0.8)
        out.append((f, "spline", slope, span, width, bool(apart), alpha, *rmse))
    return df.sparkSession.createDataFrame(out, "feature string, kind string, slope double, curve_span double, line_span double, nonlinear boolean, alpha double, linear_rmse double, spline_rmse double")
