"""Time series by series key: lags, smoothing, decomposition, forecasts, all as windows over a series.

Every window is partitioned by the series, so work spreads over series and one series is sorted
by one task; a table without a key is one series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.metrics import forecast as forecast_metrics
from quern.operators.metrics import naive_scale, running
from quern.runtime import materialize


def _w(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def _whole(by: list[str], order: str):
    return _w(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def valid_size(valid: float | int, n: int) -> int:
    """Rows of the validation tail: a share of n (banker's rounding, at least 1) or a number."""
    if valid < 0:
        raise ValueError("valid size is negative")
    if isinstance(valid, float) and 0 < valid < 1:
        return max(1, round(valid * n))
    return min(int(valid), n - 1)


def lagged(df: DataFrame, y: str, order: str, by: list[str], lags: list[int], horizon: int = 1, valid: int = 0, exogenous: list[str] | None = None) -> DataFrame:
    """Supervised rows: lag_k = y at origin + 1 - k, the target after the origin, a split by the tail.

    Rows without all lags or targets go. With a horizon over 1 the target is an array.
    """
    lags = sorted({k for k in lags if k > 0})
    if not lags or horizon <= 0:
        raise ValueError("lags and horizon must be positive")
    w = _w(by, order)
    steps = [F.lead(y, h).over(w) for h in range(1, horizon + 1)]
    target = steps[0] if horizon == 1 else F.array(*steps)
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    rows = df.select(
        *by,
        order,
        *(F.lag(y, k - 1).over(w).alias(f"lag_{k}") for k in lags),
        *(F.col(c).alias(f"{c}@t") for c in exogenous or []),
        target.alias("target"),
        (F.row_number().over(w)).alias("_at"),
        back.alias("_back"),
    )
    rows = rows.where((F.col("_at") >= lags[-1]) & (F.col("_back") > horizon))
    split = F.when(F.col("_back") <= horizon + valid, "valid").otherwise("train")
    return rows.withColumn("split", split).drop("_at", "_back")


def centered_average(y: str, order: str, by: list[str], width: int) -> Column:
    """Moving average with the ends repeated beyond the series; an even width grows by one."""
    width = max(3, width)
    width += 1 - width % 2
    half = width // 2
    w, whole = _w(by, order), _whole(by, order)
    at, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    inside = F.sum(y).over(w.rowsBetween(-half, half))
    left = F.greatest(F.lit(0), F.lit(half + 1) - at) * F.first(y).over(whole)
    right = F.greatest(F.lit(0), at + half - n) * F.last(y).over(whole)
    return (inside + left + right) / width


def decompose(df: DataFrame, y: str, order: str, by: list[str], period: int, trend_window: int | None = None) -> DataFrame:
    """Additive trend, seasonal and residual; series shorter than two periods go."""
    w, whole = _w(by, order), _whole(by, order)
    rows = df.select(*by, order, y, centered_average(y, order, by, trend_window or period).alias("trend"))
    rows = rows.withColumn("_phase", F.pmod(F.row_number().over(w) - 1, F.lit(period))).withColumn("_n", F.count(F.lit(1)).over(whole))
    rows = rows.where(F.col("_n") >= 2 * period)
    phase = F.avg(F.col(y) - F.col("trend")).over(Window.partitionBy(*by, "_phase"))
    rows = rows.withColumn("_mean", phase)
    # The mean of the phases' means, each once: the first row of every phase stands for it.
    centre = F.avg(F.when(F.row_number().over(w) <= period, F.col("_mean"))).over(Window.partitionBy(*by))
    rows = rows.withColumn("seasonal", F.col("_mean") - centre)
    return rows.select(*by, order, y, "trend", "seasonal", (F.col(y) - F.col("trend") - F.col("seasonal")).alias("resid"))


def difference(df: DataFrame, y: str, order: str, by: list[str], d: int = 1, seasonal: int = 0, period: int = 1) -> DataFrame:
    """Differences at lag 1 (``d`` times) after seasonal ones; rows without a predecessor go."""
    out = df
    for lag in [period] * seasonal + [1] * d:
        out = out.withColumn(y, F.col(y) - F.lag(y, lag).over(_w(by, order))).where(F.col(y).isNotNull())
    return out


def undifference(df: DataFrame, diff: str, first: str, order: str, by: list[str]) -> DataFrame:
    """Running sum of differences on top of the last known value in ``first``."""
    return df.withColumn(diff, F.col(first) + F.sum(diff).over(_w(by, order)))


def rolling_origin(df: DataFrame, y: str, order: str, by: list[str], strategy: str, min_train: int, horizon: int = 1, window: int = 3, period: int = 1) -> DataFrame:
    """Forecasts of every origin from ``min_train`` rows on: order, step, y and yhat.

    naive repeats the last value, seasonal_naive the last period, moving_average forecasts the mean
    of the last ``window`` values and feeds forecasts back. All are closed forms of lags.
    """
    w = _w(by, order)
    at = F.row_number().over(w)
    left = F.count(F.lit(1)).over(_whole(by, order)) - at
    history = F.reverse(F.array(*(F.lag(y, k).over(w) for k in range(max(window, period)))))
    rows = df.select(*by, order, at.alias("_at"), left.alias("_left"), history.alias("_h"), *(F.lead(y, h).over(w).alias(f"_y{h}") for h in range(1, horizon + 1)))
    rows = rows.where((F.col("_at") >= min_train) & (F.col("_left") >= horizon))
    known = F.filter("_h", lambda v: v.isNotNull())
    if strategy == "naive":
        path = F.array_repeat(F.element_at(known, -1), horizon)
    elif strategy == "seasonal_naive":
        season = F.when(F.size(known) >= period, F.slice(known, -period, period)).otherwise(F.array(F.element_at(known, -1)))
        path = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.get(season, F.pmod(h, F.size(season)).cast("int")))
    else:
        start = F.struct(known.alias("h"), F.array().cast("array<double>").alias("out"))

        def step(acc: Column, _: Column) -> Column:
            used = F.slice(acc["h"], -F.least(F.lit(window), F.size(acc["h"])), F.lit(window))
            mean = F.aggregate(used, F.lit(0.0), lambda a, v: a + v) / F.size(used)
            return F.struct(F.concat(acc["h"], F.array(mean)).alias("h"), F.concat(acc["out"], F.array(mean)).alias("out"))

        path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda acc: acc["out"])
    pairs = F.arrays_zip(F.array(*(F.col(f"_y{h}") for h in range(1, horizon + 1))).alias("y"), path.alias("yhat"))
    out = rows.select(*by, order, F.posexplode(pairs).alias("step", "p"))
    return out.select(*by, order, (F.col("step") + 1).alias("step"), F.col("p").getField("y").alias("y"), F.col("p").getField("yhat").alias("yhat"))


def normal_equations(df: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """Sums of products, as flat arrays: the whole fit of a linear model in one partial aggregate."""
    names = ["1", *features]
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    xx = F.array(*(F.sum(col(a) * col(b)) for a in names for b in names))
    xy = F.array(*(F.sum(col(a) * F.col(target)) for a in names))
    return df.groupBy(*by).agg(xx.alias("xx"), xy.alias("xy"), F.count("*").alias("n"))


def fit_linear(df: DataFrame, features: list[str], target: str, by: list[str], ridge: float = 0.0) -> DataFrame:
    """intercept and coefficients of least squares (minimum norm where singular), series by series.

    Only the k x k sums of each series reach Python, a row for each series.
    """
    k = len(features) + 1

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        penalty = np.diag([0.0] + [ridge] * (k - 1))
        return pd.Series([np.linalg.lstsq(np.reshape(a, (k, k)) + penalty, b, rcond=None)[0].tolist() for a, b in zip(xx, xy, strict=True)])

    return normal_equations(df, features, target, by).select(*by, solve("xx", "xy").alias("coefficients"), "n")


def autoregressive(df: DataFrame, y: str, order: str, by: list[str], lags: list[int], horizon: int, ridge: float = 0.0) -> DataFrame:
    """Recursive forecasts after the end of each series by a fitted autoregression: step and yhat."""
    lags = sorted(lags)
    names = [f"lag_{k}" for k in lags]
    fitted = fit_linear(lagged(df, y, order, by, lags), names, "target", by, ridge)
    deep = lags[-1]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    tail = df.select(*by, F.col(y).alias("_y"), rank.alias("_r")).where(F.col("_r") <= deep)
    tail = tail.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("o"), F.col("_y").alias("v")))), lambda s: s["v"]).alias("h"))

    def step(acc: Column, _: Column) -> Column:
        value = F.get("coefficients", F.lit(0))
        for i, k in enumerate(lags):
            value = value + F.get("coefficients", F.lit(i + 1)) * F.element_at(acc, -k)
        return F.concat(acc, F.array(value))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("h"), step)
    out = fitted.join(tail, by).where(F.size("h") == deep)
    out = out.select(*by, F.posexplode(F.slice(path, deep + 1, horizon)).alias("step", "yhat"))
    return out.withColumn("step", F.col("step") + 1)


def lag_table(df: DataFrame, columns: list[str], order: str, by: list[str], most: int) -> DataFrame:
    """``columns`` and their values 1 .. ``most`` rows before, as ``name_k``; null where there is no such row.

    With series keys these are windows by series. A single series has its rows numbered range by
    range, and each row is sent to the ``most`` rows after it, so no task sees the whole series.
    """
    if by:
        w = _w(by, order)
        return df.select(*by, order, *columns, *(F.lag(c, k).over(w).alias(f"{c}_{k}") for c in columns for k in range(1, most + 1)))
    rows = df.select(order, *columns).withColumn("_one", F.lit(1).cast("long"))
    rows = materialize(running(rows, order, {"_at": "_one"}), "lag-rows")
    sent = rows.select(F.explode(F.sequence(F.lit(0), F.lit(most))).alias("_k"), "_at", order, *columns).withColumn("_to", F.col("_at") + F.col("_k"))
    pick = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    out = sent.groupBy("_to").agg(
        pick(order, 0).alias(order), *(pick(c, 0).alias(c) for c in columns), *(pick(c, k).alias(f"{c}_{k}") for c in columns for k in range(1, most + 1)), F.min("_k").alias("_own")
    )
    return out.where("_own = 0").drop("_own", "_to")


def _f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) by the continued fraction of the incomplete beta function."""
    if not f > 0:
        return 1.0
    a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * f)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, its continued fraction taken by Lentz's method."""
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    least = 1e-300
    value = c = 1.0
    d = 0.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + step * d) or least)
        c = (1 + step / c) or least
        value *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * (value - 1)


def granger(df: DataFrame, pairs: list[tuple[str, str]], order: str, max_lag: int, by: list[str] | None = None) -> DataFrame:
    """cause, effect, lag, F and p of adding lags of the cause to an autoregression of the effect, for each pair and lag.

    Rows that miss a value of any column go first. All sums of all pairs and lags are one aggregate; a small
    matrix for each reaches Python.
    """
    by = by or []
    columns = sorted({c for p in pairs for c in p})
    rows = lag_table(df.dropna(subset=columns), columns, order, by, max_lag)
    lags = range(1, max_lag + 1)
    item = lambda x, y: F.struct(F.lit(x).alias("cause"), F.lit(y).alias("effect"), F.col(y).alias("t"), *(F.col(f"{y}_{k}").alias(f"y{k}") for k in lags), *(F.col(f"{x}_{k}").alias(f"x{k}") for k in lags))
    long = rows.select(*by, F.explode(F.array(*(item(x, y) for x, y in pairs))).alias("p")).select(*by, "p.*")

    def sums(lag: int) -> Column:
        there = F.col(f"y{lag}").isNotNull() & F.col(f"x{lag}").isNotNull()
        terms = [F.lit(1.0), *(F.col(f"y{k}") for k in range(1, lag + 1)), *(F.col(f"x{k}") for k in range(1, lag + 1))]
        total = lambda c: F.sum(F.when(there, c))
        target = F.col("t")
        return F.struct(
            F.lit(lag).alias("lag"), F.array(*(total(a * b) for a in terms for b in terms)).alias("xx"), F.array(*(total(a * target) for a in terms)).alias("xy"),
            total(target * target).alias("yy"), F.count(F.when(there, 1)).alias("n"),
        )

    @F.pandas_udf("f double, p double")
    def statistic(lag: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for k, a, b, c, m in zip(lag, xx, xy, yy, n, strict=True):
            size, free = 2 * k + 1, m - 2 * k - 1
            if free <= 0:
                out.append((float("nan"), float("nan")))
                continue
            full, b = np.reshape(np.asarray(a, float), (size, size)), np.asarray(b, float)
            small = full[: k + 1, : k + 1]
            ssr = [c - float(np.linalg.lstsq(s, v, rcond=None)[0] @ v) for s, v in ((small, b[: k + 1]), (full, b))]
            f = (ssr[0] - ssr[1]) / k / (ssr[1] / free) if ssr[1] > 0 else float("nan")
            out.append((f, _f_tail(f, k, free)))
        return pd.DataFrame(out, columns=["f", "p"])

    found = long.groupBy(*by, "cause", "effect").agg(F.array(*(sums(k) for k in lags)).alias("_sums")).select(*by, "cause", "effect", F.inline("_sums"))
    found = found.withColumn("_test", statistic("lag", "xx", "xy", "yy", "n"))
    return found.select(*by, "cause", "effect", "lag", F.col("_test.f").alias("f_statistic"), F.col("_test.p").alias("p_value"))


def best_lags(tests: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """The lag of the smallest p of each pair (the first of equal ones), and whether it is significant."""
    known = tests.where(~F.isnan("p_value"))
    best = known.groupBy(*keys).agg(F.min(F.struct("p_value", "lag", "f_statistic")).alias("b"))
    return best.select(*keys, F.col("b.lag").alias("lag"), F.col("b.f_statistic").alias("f_statistic"), F.col("b.p_value").alias("p_value"), (F.col("b.p_value") < alpha).alias("significant"))


def tail(df: DataFrame, order: str, by: list[str], size: int, before: bool = False) -> DataFrame:
    """The last ``size`` rows of each series, or with ``before`` those before them."""
    if size < 1:
        raise ValueError("size must be positive")
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    out = df.withColumn("_back", back)
    return out.where(F.col("_back") > size if before else F.col("_back") <= size).drop("_back")


def arima(
    df: DataFrame, y: str, order: str, by: list[str], horizon: int, spec: tuple[int, int, int] = (1, 0, 0), seasonal: tuple[int, int, int, int] = (0, 0, 0, 1),
    trend: str = "c", ridge: float = 1e-8, exogenous: list[str] | None = None, future: DataFrame | None = None, backend: str = "least_squares",
) -> DataFrame:
    """Forecasts (step, yhat) of an autoregression on (seasonal) differences by least squares, series by series.

    d and D are 0 or 1. The backend ``least_squares`` leaves moving-average orders out of the fit; ``two_stage`` (``arma.forecast``)
    and ``likelihood`` (``arma_likelihood.forecast``) have them, without exogenous columns. The columns fitted and ignored tell the orders. ``future``
    has the series keys, step (from 1) and the exogenous columns. The fit is a k x k aggregate
    for each series, forecasts are folded in the JVM from each series' last rows.
    """
    from quern.operators import arma, arma_likelihood

    if backend in ("two_stage", "likelihood"):
        if exogenous:
            raise ValueError(f"the backend {backend} takes no exogenous columns")
        if backend == "likelihood":
            return arma_likelihood.forecast(df, y, order, by, horizon, spec, seasonal, trend)
        return arma.forecast(df, y, order, by, horizon, spec, seasonal, trend, ridge)
    (p, d, q), (sp, sd, sq, period) = spec, seasonal
    exogenous = exogenous or []
    if backend != "least_squares":
        raise ValueError(f"unknown backend {backend}")
    if d not in (0, 1) or sd not in (0, 1):
        raise ValueError("d and D are 0 or 1")
    if exogenous and future is None:
        raise ValueError("exogenous columns need their future values")
    period = max(1, period)
    lags = [*range(1, p + 1), *(period * i for i in range(1, sp + 1))]
    w = _w(by, order)
    z = df.select(*by, F.col(order).alias("_o"), F.col(y).cast("double").alias("_y"), F.col(y).cast("double").alias("_z"), *exogenous)
    z = difference(z, "_z", "_o", by, d, sd, period)
    w = _w(by, "_o")
    names = [f"_l{i}" for i in range(len(lags))]
    design = z.select(*by, "_z", *exogenous, *(F.lag("_z", k).over(w).alias(n) for n, k in zip(names, lags, strict=True)))
    design = design.dropna(subset=names) if names else design
    constant = trend.lower() in ("c", "constant", "intercept")
    terms = [*([F.lit(1.0)] if constant else []), *map(F.col, names), *map(F.col, exogenous)]
    k = len(terms)
    xx, xy = F.array(*(F.sum(a * b) for a in terms for b in terms)), F.array(*(F.sum(a * F.col("_z")) for a in terms))
    none = F.array().cast("array<double>")
    fitted = design.groupBy(*by).agg((xx if k else none).alias("xx"), (xy if k else none).alias("xy"))

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.solve(np.reshape(a, (k, k)) + ridge * np.eye(k), b).tolist() if k else [] for a, b in zip(xx, xy, strict=True)])

    fitted = fitted.select(*by, solve("xx", "xy").alias("w"))
    deep_y, deep_z = period * sd + d + 1, max([*lags, 1])
    last = lambda frame, c, n: (
        tail(frame.select(*by, "_o", c), "_o", by, n).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", c))), lambda s: s[c]).alias(c))
    )
    state = last(df.select(*by, F.col(order).alias("_o"), F.col(y).cast("double").alias("_y")), "_y", deep_y).join(last(z, "_z", deep_z), by).join(fitted, by)
    if exogenous:
        ahead = future.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("step", *exogenous))), lambda s: F.array(*(s[c].cast("double") for c in exogenous))).alias("x"))
        state = state.join(ahead, by).where(F.size("x") >= horizon)

    def step(acc: Column, i: Column) -> Column:
        at = iter(range(k))
        value = F.get("w", F.lit(next(at))) if constant else F.lit(0.0)
        for lag in lags:
            back = F.when(F.size(acc["z"]) >= lag, F.element_at(acc["z"], -lag)).otherwise(F.lit(0.0))
            value = value + F.get("w", F.lit(next(at))) * back
        for c in range(len(exogenous)):
            value = value + F.get("w", F.lit(next(at))) * F.get(F.get("x", i - 1), F.lit(c))
        level = value
        if d:
            level = level + F.element_at(acc["h"], -1)
        if sd:
            level = level + F.element_at(acc["h"], -period)
        if d and sd:
            level = level - F.element_at(acc["h"], -period - 1)
        grow = lambda name, v: F.concat(acc[name], F.array(v)).alias(name)
        return F.struct(grow("h", level), grow("z", value), grow("out", level))

    start = F.struct(F.col("_y").alias("h"), F.col("_z").alias("z"), none.alias("out"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda acc: acc["out"])
    done, left = arma.orders((p, d, 0), (sp, sd, 0, period)), arma.orders((0, 0, q), (0, 0, sq, period)) if q or sq else ""
    out = state.select(*by, F.posexplode(path).alias("step", "yhat")).withColumn("step", F.col("step") + 1)
    return out.withColumns({"fitted": F.lit(done), "ignored": F.lit(left)})


def holdout(df: DataFrame, y: str, order: str, by: list[str], size: int, forecaster, period: int = 1) -> DataFrame:
    """Metrics of forecasts of each series' last ``size`` rows, made from the rows before them.

    ``forecaster`` takes (history, horizon) and returns the series keys, step and yhat. mase is in units of the
    history's (seasonal) naive error.
    """
    history = tail(df, order, by, size, before=True)
    steps = tail(df, order, by, size).select(*by, F.col(y).alias("_y"), F.row_number().over(_w(by, order)).alias("step"))
    both = steps.join(forecaster(history, size), [*by, "step"])
    scale = naive_scale(history, y, order, by, period)
    return forecast_metrics(both.join(scale, by), "_y", "yhat", F.col("scale"), by)


class LagEstimator:
    """Any estimator of ``pyspark.ml`` on lag features, with recursive forecasts; never fitted again on what it forecasts."""

    def __init__(self, estimator, y: str, order: str, by: list[str], lags: list[int]):
        self.estimator, self.y, self.order, self.by, self.lags = estimator, y, order, by, sorted({k for k in lags if k > 0})
        self.model = None

    def fit(self, df: DataFrame) -> LagEstimator:
        rows = lagged(df, self.y, self.order, self.by, self.lags)
        rows = rows.select(array_to_vector(F.array(*(F.col(f"lag_{k}").cast("double") for k in self.lags))).alias("features"), F.col("target").cast("double").alias("label"))
        self.model = self.estimator.fit(rows)
        return self

    def forecast(self, df: DataFrame, horizon: int) -> DataFrame:
        """step and yhat after the end of each series of ``df`` that has all lags: a model pass for each step."""
        deep = self.lags[-1]
        last = tail(df.select(*self.by, self.order, self.y), self.order, self.by, deep)
        held = F.transform(F.sort_array(F.collect_list(F.struct(self.order, self.y))), lambda s: s[self.y].cast("double"))
        now = last.groupBy(*self.by).agg(held.alias("_h")).where(F.size("_h") == deep)
        for _ in range(horizon):
            now = now.withColumn("features", array_to_vector(F.array(*(F.element_at("_h", -k) for k in self.lags))))
            now = self.model.transform(now).select(*self.by, F.concat("_h", F.array("prediction")).alias("_h"))
        out = now.select(*self.by, F.posexplode(F.slice("_h", deep + 1, horizon)).alias("step", "yhat"))
        return out.withColumn("step", F.col("step") + 1)
