"""A sparse vector autoregression of order 1: which column's past helps to tell which column's next value.

The table is read twice: for means and deviations, and for the products of standardised values with those a row before, which are sums by
Arrow batch. The fit, by proximal gradient steps, needs these k x k sums alone, so it costs the same for any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.moments import MOST_COLUMNS
from quern.operators.timeseries import lag_table


@dataclass
class Moments:
    """Sums over ``n`` steps: of products of the row before (past), of each row with the one before (cross), of squares (now)."""

    names: list[str]
    n: int
    past: np.ndarray
    cross: np.ndarray
    now: np.ndarray


def moments(df: DataFrame, columns: list[str], order: str, by: list[str] | None = None) -> Moments:
    """Of standardised columns (population deviation; a constant column is 0). Steps that miss a value count for nothing."""
    k, by = len(columns), by or []
    if not 0 < k <= MOST_COLUMNS:
        raise ValueError(f"1 to {MOST_COLUMNS} columns")
    names = [f"c{i}" for i in range(k)]
    rows = df.select(*by, order, *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)))
    stats = rows.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)).first()
    mean, spread = np.array([stats[f"m_{n}"] or 0.0 for n in names]), np.array([stats[f"s_{n}"] or 0.0 for n in names])
    scale = np.where(spread > 1e-12, 1 / np.where(spread > 1e-12, spread, 1), 0.0)
    steps = lag_table(rows, names, order, by, 1).select(*names, *(f"{n}_1" for n in names)).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2 * k, 2 * k)), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            x = (x - np.tile(mean, 2)) * np.tile(scale, 2)
            total += x.T @ x
            n += len(x)
        i, j = (a.ravel() for a in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel()), pa.array(np.full(i.size, n))], names=["i", "j", "s", "n"])

    total, n = np.zeros((2 * k, 2 * k)), 0
    for r in steps.mapInArrow(run, "i long, j long, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        total[r.i, r.j], n = r.s, r.n
    return Moments(columns, n, total[k:, k:], total[:k, k:], np.diag(total[:k, :k]).copy())


def solve(m: Moments, l1: float, steps: int = 5000, tolerance: float = 1e-10) -> np.ndarray:
    """A (effect x cause) that minimises the mean squared error of A times the past plus ``l1`` times the sum of |A|."""
    k = len(m.names)
    a = np.zeros((k, k))
    if not m.n:
        return a
    weight = 2 / (m.n * k)
    step = 1 / max(weight * float(np.linalg.eigvalsh(m.past)[-1]), 1e-300)
    ahead, t = a, 1.0
    for _ in range(steps):
        moved = ahead - step * weight * (ahead @ m.past - m.cross)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0.0)
        # Momentum, dropped where it points uphill.
        after = 1.0 if ((ahead - new) * (new - a)).sum() > 0 else (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + ((t - 1) / after if after > 1 else 0.0) * (new - a)
        done, a, t = float(np.abs(new - a).max()), new, after
        if done < tolerance:
            break
    return a


def network(df: DataFrame, columns: list[str], order: str, by: list[str] | None = None, l1: float = 0.005) -> DataFrame:
    """effect, cause and coefficient of every pair whose coefficient isn't 0, with the fit's mse and r2."""
    m = moments(df, columns, order, by)
    a = solve(m, l1)
    k = len(columns)
    squares = float(np.einsum("ij,jl,il->", a, m.past, a) - 2 * (a * m.cross).sum() + m.now.sum())
    total = float(m.now.sum())
    mse, r2 = squares / max(1, m.n * k), 1 - squares / max(total, 1e-12)
    rows = [(columns[i], columns[j], float(a[i, j]), mse, r2) for i in range(k) for j in range(k) if a[i, j] != 0]
    return df.sparkSession.createDataFrame(rows, "effect string, cause string, coefficient double, mse double, r2 double")
