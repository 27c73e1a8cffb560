"""Autoregressions with moving-average terms, fitted in two stages of least squares (Hannan and Rissanen).

A long autoregression of the differenced series gives residuals; the series is then regressed on its own lags and on
lags of these residuals. Both fits are sums of products by series, so a table of many series is one pass of
each, and a single long series has its lags from ``lag_table``, without a task that sees all of it. Forecasts are folded in the JVM
from each series' last values and last residuals; residuals of steps that are still to come are zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.timeseries import difference, lag_table, tail


def _fit(rows: DataFrame, terms: list[Column], target: str, by: list[str], ridge: float) -> DataFrame:
    """w (coefficients of ``terms``) and n by series; the upper half of the products is summed."""
    k = len(terms)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.groupBy(*by).agg(F.array(*(F.sum(terms[i] * terms[j]) for i, j in upper)).alias("xx"), F.array(*(F.sum(t * F.col(target)) for t in terms)).alias("xy"), F.count("*").alias("n"))

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xx, xy, strict=True):
            full = np.zeros((k, k))
            for (i, j), v in zip(upper, a, strict=True):
                full[i, j] = full[j, i] = v
            out.append(np.linalg.lstsq(full + ridge * np.eye(k), np.asarray(b, float), rcond=None)[0].tolist())
        return pd.Series(out)

    return sums.select(*by, solve("xx", "xy").alias("w"), "n")


def _joined(rows: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    """One fitted row for each series; without a key there is one row in all."""
    return rows.join(fitted, by) if by else rows.crossJoin(F.broadcast(fitted))


def _lags(spec: tuple[int, int, int], seasonal: tuple[int, int, int, int]) -> tuple[list[int], list[int]]:
    (p, _, q), (sp, _, sq, period) = spec, seasonal
    period = max(1, period)
    with_season = lambda n, s: sorted({*range(1, n + 1), *(period * i for i in range(1, s + 1))})
    return with_season(p, sp), with_season(q, sq)


def residuals(z: DataFrame, column: str, order: str, by: list[str], long_order: int, ridge: float = 1e-8) -> DataFrame:
    """``by``, ``order``, ``column`` and _e: what an autoregression of ``long_order`` leaves of it; rows without all lags go."""
    rows = lag_table(z, [column], order, by, long_order)
    names = [f"{column}_{k}" for k in range(1, long_order + 1)]
    rows = rows.dropna(subset=[column, *names])
    fitted = _fit(rows, [F.lit(1.0), *map(F.col, names)], column, by, ridge).drop("n")
    expected = F.get("w", F.lit(0))
    for i, name in enumerate(names):
        expected = expected + F.get("w", F.lit(i + 1)) * F.col(name)
    return _joined(rows, fitted, by).select(*by, order, column, (F.col(column) - expected).alias("_e"))


def fit(
    df: DataFrame, y: str, order: str, by: list[str], spec: tuple[int, int, int], seasonal: tuple[int, int, int, int] = (0, 0, 0, 1),
    trend: str = "c", ridge: float = 1e-8, long_order: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(coefficients by series: intercept, ar, ma and n; the differenced series with its residuals).

    ``long_order`` is that of the first stage; by default it is four more than the deepest lag.
    """
    (_, d, _), (_, sd, _, period) = spec, seasonal
    if d not in (0, 1) or sd not in (0, 1):
        raise ValueError("d and D are 0 or 1")
    own, past = _lags(spec, seasonal)
    long_order = long_order or max([0, *own, *past]) + 4
    z = df.select(*by, F.col(order).alias("_o"), F.col(y).cast("double").alias("_z"))
    z = difference(z, "_z", "_o", by, d, sd, max(1, period))
    z = residuals(z, "_z", "_o", by, long_order, ridge)
    deepest = max([1, *own, *past])
    rows = lag_table(z, ["_z", "_e"], "_o", by, deepest)
    names = [*(f"_z_{k}" for k in own), *(f"_e_{k}" for k in past)]
    rows = rows.dropna(subset=names) if names else rows
    constant = trend.lower() in ("c", "constant", "intercept")
    terms = [*([F.lit(1.0)] if constant else []), *map(F.col, names)]
    if not terms:
        raise ValueError("nothing to fit")
    fitted = _fit(rows, terms, "_z", by, ridge)
    at = int(constant)
    part = lambda a, n: F.slice("w", a + 1, n) if n else F.array().cast("array<double>")
    fitted = fitted.select(*by, (F.get("w", F.lit(0)) if constant else F.lit(0.0)).alias("intercept"), part(at, len(own)).alias("ar"), part(at + len(own), len(past)).alias("ma"), "n")
    return fitted, z


def forecast(
    df: DataFrame, y: str, order: str, by: list[str], horizon: int, spec: tuple[int, int, int], seasonal: tuple[int, int, int, int] = (0, 0, 0, 1),
    trend: str = "c", ridge: float = 1e-8, long_order: int | None = None,
) -> DataFrame:
    """step and yhat after the end of each series, with the orders that were fitted (``fitted``) and left out (``ignored``)."""
    if horizon < 1:
        raise ValueError("horizon must be positive")
    (_, d, _), (_, sd, _, period) = spec, seasonal
    period = max(1, period)
    own, past = _lags(spec, seasonal)
    fitted, z = fit(df, y, order, by, spec, seasonal, trend, ridge, long_order)

    def last(frame: DataFrame, c: str, n: int) -> DataFrame:
        held = F.transform(F.sort_array(F.collect_list(F.struct("_o", c))), lambda s: s[c])
        return tail(frame.select(*by, "_o", c), "_o", by, n).groupBy(*by).agg(held.alias(c))

    levels = df.select(*by, F.col(order).alias("_o"), F.col(y).cast("double").alias("_y"))
    state = _joined(last(levels, "_y", period * sd + d + 1), last(z, "_z", max([1, *own])), by)
    state = _joined(_joined(state, last(z, "_e", max([1, *past])), by), fitted.drop("n"), by)
    return ahead(state, by, horizon, spec, seasonal)


def ahead(state: DataFrame, by: list[str], horizon: int, spec: tuple[int, int, int], seasonal: tuple[int, int, int, int]) -> DataFrame:
    """Forecasts from each series' state: last levels (_y), differences (_z) and residuals (_e), oldest first, and its coefficients."""
    (_, d, _), (_, sd, _, period) = spec, seasonal
    period = max(1, period)
    own, past = _lags(spec, seasonal)

    def step(acc: Column, _: Column) -> Column:
        value = F.col("intercept")
        for name, memory, lags in (("ar", "z", own), ("ma", "e", past)):
            for i, lag in enumerate(lags):
                back = F.when(F.size(acc[memory]) >= lag, F.element_at(acc[memory], -lag)).otherwise(F.lit(0.0))
                value = value + F.get(name, F.lit(i)) * back
        level = value
        if d:
            level = level + F.element_at(acc["h"], -1)
        if sd:
            level = level + F.element_at(acc["h"], -period)
        if d and sd:
            level = level - F.element_at(acc["h"], -period - 1)
        grow = lambda name, v: F.concat(acc[name], F.array(v)).alias(name)
        return F.struct(grow("h", level), grow("z", value), grow("e", F.lit(0.0)), grow("out", level))

    start = F.struct(F.col("_y").alias("h"), F.col("_z").alias("z"), F.col("_e").alias("e"), F.array().cast("array<double>").alias("out"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda acc: acc["out"])
    done = orders(spec, seasonal)
    return state.select(*by, F.posexplode(path).alias("step", "yhat")).select(*by, (F.col("step") + 1).alias("step"), "yhat", F.lit(done).alias("fitted"), F.lit("").alias("ignored"))


def orders(spec: tuple[int, int, int], seasonal: tuple[int, int, int, int]) -> str:
    """(p, d, q) and, where there are any, the seasonal orders, as text."""
    text = ",".join(map(str, spec))
    return f"({text})" if not any(seasonal[:3]) else f"({text})({','.join(map(str, seasonal[:3]))})[{seasonal[3]}]"
