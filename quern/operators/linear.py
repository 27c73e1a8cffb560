"""Orthogonal feature maps and linear models on them: fits are k x k sums, applications are projections."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.moments import pair_sums


def expand(columns: dict[str, Column], raw: bool = True, square: bool = True, interactions: bool = True) -> dict[str, Column]:
    """The columns, their squares and the products of each pair, by name."""
    names = list(columns)
    out = dict(columns) if raw else {}
    out |= {f"{n}^2": columns[n] * columns[n] for n in names} if square else {}
    out |= {f"{a}*{b}": columns[a] * columns[b] for i, a in enumerate(names) for b in names[i + 1 :]} if interactions else {}
    return out


class OrthogonalMap(NamedTuple):
    """Means and components of expanded features, strongest first; each component's largest entry is positive."""

    mean: list[float]
    components: list[list[float]]
    energy: float

    def columns(self, expanded: list[Column]) -> list[Column]:
        """q0, q1, ... of a row."""
        out = []
        for k, weights in enumerate(self.components):
            total = F.lit(0.0)
            for value, mean, weight in zip(expanded, self.mean, weights, strict=True):
                total = total + (value - F.lit(mean)) * F.lit(weight)
            out.append(total.alias(f"q{k}"))
        return out


def fit_orthogonal(df: DataFrame, expanded: list[Column], energy: float | None = 0.999, most: int | None = None) -> OrthogonalMap:
    """Principal directions that hold a share of the energy, at least one and at most ``most``.

    Rows with a missing value count in the sums they have values for. Only k x k sums reach the driver.
    """
    k = len(expanded)
    if not k:
        raise ValueError("no features")
    means = [m or 0.0 for m in df.agg(*(F.avg(c) for c in expanded)).first()]
    gram = np.zeros((k, k))
    for r in pair_sums(df, expanded).collect():
        gram[r.i, r.j] = gram[r.j, r.i] = r.xy
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
    total = values.sum()
    share = np.cumsum(values) / total if total > 0 else np.zeros(k)
    rank = 1 if total <= 0 else k if energy is None else int(np.searchsorted(share, energy) + 1)
    rank = max(1, min(rank, k, most or k))
    signs = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])
    return OrthogonalMap(list(map(float, means)), (vectors * signs[:, None])[:rank].tolist(), float(share[rank - 1]))


def predict(features: list[Column], weights: list[float], intercept: float = 0.0) -> Column:
    total = F.lit(float(intercept))
    for value, weight in zip(features, weights, strict=True):
        total = total + F.lit(float(weight)) * value
    return total


def gradient(df: DataFrame, features: list[Column], target: Column, weights: list[float], intercept: float = 0.0, l2: float = 0.0) -> DataFrame:
    """One row: the mean squared error's gradient by intercept and weights (arrays in their order), one aggregate."""
    error = predict(features, weights, intercept) - target
    slopes = [2 * F.avg(f * error) + F.lit(2 * l2 * w) for f, w in zip(features, weights, strict=True)]
    return df.agg((2 * F.avg(error)).alias("intercept"), F.array(*slopes).alias("weights"))
