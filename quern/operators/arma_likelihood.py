"""Autoregressions with moving-average terms by their conditional Gaussian likelihood.

The likelihood is conditional on the first rows of a series and on residuals of zero before them; its maximum is the least sum of
squared residuals. A residual needs the one before it, so a series is cut into blocks of consecutive rows, also one
that holds most of the table. For given coefficients a block's residuals are linear in the residuals before it: one pass gives each block's map
from its state before to its state after, a streamed scan of these small maps gives the states, and the sums of squares and of
derivatives follow from all blocks at once. Coefficients go by Levenberg and Marquardt's steps, of all series in the same job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import arma
from quern.runtime import bounded_batches, hand_over, materialize, scope

BLOCK_ROWS = 1 << 14
ROUNDS = 60
#: Moving-average coefficients to begin with.
START = 0.1
#: A series is settled by a step that lowers its sum of squares by this share at most.
SETTLED = 1e-10


@dataclass(frozen=True)
class Shape:
    """Lags and differences of a model: what is regressed on what."""

    own: tuple[int, ...]
    past: tuple[int, ...]
    steps: tuple[int, ...]
    constant: bool

    @property
    def halo(self) -> int:
        """Rows before a row that it needs."""
        return sum(self.steps) + max([0, *self.own])

    @property
    def memory(self) -> int:
        return max([0, *self.past])

    @property
    def regressors(self) -> int:
        return int(self.constant) + len(self.own)

    @property
    def size(self) -> int:
        return self.regressors + len(self.past)


def shape(spec: tuple[int, int, int], seasonal: tuple[int, int, int, int], trend: str) -> Shape:
    (_, d, _), (_, sd, _, period) = spec, seasonal
    if d not in (0, 1) or sd not in (0, 1):
        raise ValueError("d and D are 0 or 1")
    own, past = arma._lags(spec, seasonal)
    out = Shape(tuple(own), tuple(past), tuple([max(1, period)] * sd + [1] * d), trend.lower() in ("c", "constant", "intercept"))
    if not out.size:
        raise ValueError("nothing to fit")
    return out


def blocks(df: DataFrame, y: str, order: str, by: list[str], halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """_b, ``by``, _head, _tail (first and last of the series) and _full: at most ``halo`` values before the block, then its own."""
    rows = df.select(*by, F.col(order).alias("_o"), F.col(y).cast("double").alias("_y"))
    rows = rows.dropna(subset=[*by, "_o", "_y"]).where(~F.isnan("_y"))
    placed = rows.repartitionByRange(*by, "_o", "_y").withColumn("_part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_o", "_y"))
    runs = placed.withColumn("_run", F.floor((place - 1) / block_rows)).groupBy(*by, "_part", "_run")
    values = runs.agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_y"))), lambda s: s["_y"]).alias("_own"))
    packed = materialize(values.withColumn("_b", F.monotonically_increasing_id()), "series-blocks")
    # every block has a row or more, so as many blocks as rows are needed are enough
    ends = packed.select("_b", *by, "_part", "_run", F.slice("_own", -F.least(F.size("_own"), F.lit(max(halo, 1))), max(halo, 1)).alias("_end"))
    w = Window.partitionBy(*by).orderBy("_part", "_run")
    before = F.flatten(F.collect_list("_end").over(w.rowsBetween(-max(halo, 1), -1)))
    near = ends.select("_b", before.alias("_before"), F.lag("_b").over(w).isNull().alias("_head"), F.lead("_b").over(w).isNull().alias("_tail"), F.row_number().over(w).alias("_at"))
    short = F.slice("_before", F.greatest(F.size("_before") - halo, F.lit(0)) + 1, halo) if halo else F.array().cast("array<double>")
    return packed.join(near, "_b").select("_b", *by, "_at", "_head", "_tail", F.concat(short, "_own").alias("_full"))


def design(full: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The differenced values of rows with all lags, and their regressors."""
    z = np.asarray(full, float)
    for lag in s.steps:
        z = z[lag:] - z[:-lag]
    deep = max([0, *s.own])
    n = max(0, len(z) - deep)
    columns = [*([np.ones(n)] if s.constant else []), *(z[deep - k : deep - k + n] for k in s.own)]
    return z[deep:], np.column_stack(columns) if columns else np.zeros((n, 0))


def recurse(u: np.ndarray, theta: np.ndarray, s: Shape, start: np.ndarray) -> np.ndarray:
    """v[t] = u[t] - sum of theta times v[t - lag], with ``start`` as the rows before; these come first in the result."""
    m, back = s.memory, np.asarray(s.past, int)
    v = np.concatenate([start, u])
    if m:
        for t in range(m, len(v)):
            v[t] -= theta @ v[t - back]
    return v


def respond(full: np.ndarray, w: np.ndarray, s: Shape) -> np.ndarray:
    """A block's end state from a start at zero (residual, filtered residual, regressors), then its two matrices, flat."""
    z, x = design(full, s)
    m, k, theta = s.memory, s.regressors, w[s.regressors :]
    u = np.column_stack([z - x @ w[:k], -x, np.zeros((len(z), m))])
    v = recurse(u, theta, s, np.column_stack([np.zeros((m, 1 + k)), np.eye(m)]))
    twice = recurse(v[m:][:, [0, *range(1 + k, 1 + k + m)]], theta, s, np.zeros((m, 1 + m)))
    end, second = v[len(v) - m :], twice[len(twice) - m :]
    return np.concatenate([end[:, : 1 + k], second[:, :1], end[:, 1 + k :], second[:, 1:]], axis=1).ravel()


def advance(state: np.ndarray, response: np.ndarray, s: Shape) -> np.ndarray:
    """The state after a block: columns residual, regressors, filtered residual."""
    m, k = s.memory, s.regressors
    r = response.reshape(m, 2 + k + 2 * m)
    out = r[:, : 2 + k] + r[:, 2 + k : 2 + k + m] @ state
    out[:, -1] += r[:, 2 + k + m :] @ state[:, 0]
    return out


def gather(full: np.ndarray, w: np.ndarray, state: np.ndarray, s: Shape) -> np.ndarray:
    """Rows, sum of squares, upper half of the products of derivatives, and these times residuals."""
    z, x = design(full, s)
    m, k, theta = s.memory, s.regressors, w[s.regressors :]
    v = recurse(np.column_stack([z - x @ w[:k], -x]), theta, s, state[:, : 1 + k])
    f = recurse(v[m:, :1], theta, s, state[:, 1 + k :])[:, 0]
    e = v[m:, 0]
    j = np.column_stack([v[m:, 1:], *(-f[m - lag : len(f) - lag] for lag in s.past)])
    return np.concatenate([[len(e), e @ e], (j.T @ j)[np.triu_indices(s.size)], j.T @ e])


def step(held: np.ndarray, sums: np.ndarray | None, k: int) -> np.ndarray:
    """One step of Levenberg and Marquardt for one series.

    ``held`` is whether it moves, damping, rows, sum of squares, coefficients, products, gradient, and the coefficients to try next.
    """
    half = k * (k + 1) // 2
    out = held.copy()
    if sums is None or not sums[0]:
        out[0] = 0
        return out
    trial = held[4 + 2 * k + half :]
    if np.isfinite(sums).all() and sums[1] < held[3]:
        settled = held[3] - sums[1] <= SETTLED * held[3] and np.isfinite(held[3])
        out[0], out[1] = float(not settled), max(held[1] / 10, 1e-12)
        out[2:4], out[4 : 4 + k], out[4 + k : 4 + 2 * k + half] = sums[:2], trial, sums[2:]
    else:
        out[1] = held[1] * 10
    products = np.zeros((k, k))
    products[np.triu_indices(k)] = out[4 + k : 4 + k + half]
    products = products + np.triu(products, 1).T
    gradient = out[4 + k + half : 4 + 2 * k + half]
    damped = products + out[1] * np.diag(np.maximum(np.diag(products), 1e-12))
    move = np.linalg.lstsq(damped, -gradient, rcond=None)[0]
    out[4 + 2 * k + half :] = out[4 : 4 + k] + move
    if out[1] > 1e12 or np.abs(move).max() <= 1e-10 * (1e-3 + np.abs(out[4 : 4 + k]).max()):
        out[0] = 0
    return out


def _states(packed: DataFrame, s: Shape, by: list[str]) -> DataFrame:
    """_b, and the state before and after each block for the coefficients in ``_w``.

    The maps of a series' blocks are read in order, batch by batch, and only the last state is kept.
    """

    @F.pandas_udf("array<double>")
    def response(full: pd.Series, w: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series([respond(a, np.asarray(b, float), s) for a, b in zip(full, w, strict=True)])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = np.zeros((s.memory, 2 + s.regressors))
        for frame in frames:
            starts, ends = [], []
            for head, r in zip(frame["_head"], frame["_r"], strict=True):
                state = np.zeros_like(state) if head else state
                starts.append(state.ravel())
                with np.errstate(all="ignore"):
                    state = advance(state, np.asarray(r, float), s)
                ends.append(state.ravel())
            yield pd.DataFrame({"_b": frame["_b"], "_start": starts, "_end": ends})

    maps = packed.select(*by, "_at", "_head", "_b", response("_full", "_w").alias("_r"))
    placed = (maps.repartition(*by) if by else maps.repartition(1)).sortWithinPartitions(*by, "_at")
    return placed.select("_head", "_b", "_r").mapInPandas(scan, "_b long, _start array<double>, _end array<double>")


def _sums(packed: DataFrame, s: Shape, by: list[str], split: bool) -> DataFrame:
    """``by`` and what ``gather`` gives, added up; only where series are ``split`` into blocks does one begin elsewhere than at zero."""

    @F.pandas_udf("array<double>")
    def part(full: pd.Series, w: pd.Series, start: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series([gather(a, np.asarray(b, float), np.asarray(c, float).reshape(s.memory, -1) if s.memory else np.zeros((0, 2 + s.regressors)), s) for a, b, c in zip(full, w, start, strict=True)])

    size = 2 + s.size * (s.size + 1) // 2 + s.size
    zero = F.array_repeat(F.lit(0.0), s.memory * (2 + s.regressors)).alias("_start")
    begun = packed.join(_states(packed, s, by), "_b") if split and s.memory else packed.select("*", zero)
    parts = begun.select(*by, part("_full", "_w", "_start").alias("_p"))
    return parts.groupBy(*by).agg(F.array(*(F.sum(F.get("_p", F.lit(i))) for i in range(size))).alias("_sums"))


def _solve(packed: DataFrame, s: Shape, by: list[str], rounds: int) -> DataFrame:
    """``by`` and _held after the last round; a series whose steps have ended costs no more."""
    k = s.size
    half = k * (k + 1) // 2
    # at zero a residual and the value of its row are one, and so are their lags as regressors
    first = [1.0, 1e-3, 0.0, math.inf, *([0.0] * (2 * k + half + s.regressors)), *([START] * len(s.past))]

    @F.pandas_udf("array<double>")
    def move(held: pd.Series, sums: pd.Series) -> pd.Series:
        return pd.Series([step(np.asarray(a, float), None if b is None else np.asarray(b, float), k) for a, b in zip(held, sums, strict=True)])

    moving = F.get("_held", F.lit(0)) > 0
    trial = F.slice("_held", 4 + 2 * k + half + 1, k)
    split = not packed.where(~F.col("_head")).isEmpty()
    held = materialize(packed.where("_tail").select(*by, F.array(*map(F.lit, first)).alias("_held")), "coefficients")
    for _ in range(rounds):
        active = held.where(moving)
        if active.isEmpty():
            break
        now = arma._joined(packed, active.select(*by, trial.alias("_w")), by)
        sums = _sums(now, s, by, split)
        both = active.join(sums, by, "left") if by else active.crossJoin(F.broadcast(sums))
        held = materialize(both.select(*by, move("_held", "_sums").alias("_held")).unionByName(held.where(~moving)), "coefficients")
    return held


def _named(held: DataFrame, s: Shape, by: list[str]) -> DataFrame:
    at = lambda i: F.get("_held", F.lit(i))
    part = lambda start, n: F.slice("_held", start + 1, n) if n else F.array().cast("array<double>")
    n, sse, k = at(2), at(3), s.size
    loglik = -n / 2 * (F.log(2 * math.pi * sse / n) + 1)
    out = held.where(at(2) > 0).select(
        *by, (at(4) if s.constant else F.lit(0.0)).alias("intercept"), part(4 + int(s.constant), len(s.own)).alias("ar"), part(4 + s.regressors, len(s.past)).alias("ma"),
        n.cast("long").alias("n"), sse.alias("sse"), loglik.alias("loglik"), (at(0) == 0).alias("converged"),
    )
    return out.withColumn("aic", 2 * (k + 1) - 2 * F.col("loglik")).withColumn("bic", (k + 1) * F.log("n") - 2 * F.col("loglik"))


def _fitted(df: DataFrame, y: str, order: str, by: list[str], s: Shape, rounds: int, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    bounded_batches(df.sparkSession)
    packed = materialize(blocks(df, y, order, by, s.halo, block_rows), "series-blocks")
    held = _solve(packed, s, by, rounds)
    return packed, held, _named(held, s, by)


def fit(
    df: DataFrame, y: str, order: str, by: list[str], spec: tuple[int, int, int], seasonal: tuple[int, int, int, int] = (0, 0, 0, 1),
    trend: str = "c", rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """intercept, ar, ma, n, sse, loglik, aic, bic and converged by series; steps begin at zero, of moving averages at ``START``.

    Rows without a key, an order or a value count for nothing; rows of one order are taken by value. A series without a row that has
    all its lags has no row in the result.
    """
    s = shape(spec, seasonal, trend)
    with scope(df.sparkSession):
        return hand_over(_fitted(df, y, order, by, s, rounds, block_rows)[2], "likelihood")


def forecast(
    df: DataFrame, y: str, order: str, by: list[str], horizon: int, spec: tuple[int, int, int], seasonal: tuple[int, int, int, int] = (0, 0, 0, 1),
    trend: str = "c", rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """step and yhat after the end of each series, from the last values and the residuals of the fit, and the orders fitted."""
    if horizon < 1:
        raise ValueError("horizon must be positive")
    s = shape(spec, seasonal, trend)
    with scope(df.sparkSession):
        packed, held, named = _fitted(df, y, order, by, s, rounds, block_rows)
        if s.memory:
            now = arma._joined(packed, held.select(*by, F.slice("_held", 5, s.size).alias("_w")), by)
            columns = 2 + s.regressors
            last = F.transform(F.sequence(F.lit(0), F.lit(s.memory - 1)), lambda i: F.get("_end", i * columns))
            ends = packed.where("_tail").join(_states(now, s, by), "_b").select(*by, "_full", last.alias("_e"))
        else:
            ends = packed.where("_tail").select(*by, "_full", F.array().cast("array<double>").alias("_e"))

        @F.pandas_udf("array<double>")
        def differenced(full: pd.Series) -> pd.Series:
            plain = Shape((), (), s.steps, False)
            return pd.Series([design(a, plain)[0] for a in full])

        need = sum(s.steps) + 1
        levels = F.slice("_full", -F.least(F.size("_full"), F.lit(need)), need)
        state = arma._joined(ends.select(*by, levels.alias("_y"), differenced("_full").alias("_z"), "_e"), named, by)
        return hand_over(arma.ahead(state, by, horizon, spec, seasonal), "likelihood-forecast")
