"""Conditional likelihood of moving averages against a plain recursion, whatever the blocks."""

import numpy as np
import pytest

from quern.operators import arma, arma_likelihood, timeseries


def table(spark, many):
    rows = [(name, i, float(v), "x") for name, values in many.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "s string, t int, y double, n string")


def residuals(y, w, spec, seasonal=(0, 0, 0, 1)):
    """Residuals one after the other, zero before the first row that has all its lags."""
    (p, d, q), (sp, sd, sq, m) = spec, seasonal
    z = np.asarray(y, float)
    z = z[m:] - z[:-m] if sd else z
    z = np.diff(z) if d else z
    own, past = sorted({*range(1, p + 1), *(m * i for i in range(1, sp + 1))}), sorted({*range(1, q + 1), *(m * i for i in range(1, sq + 1))})
    deep, e = max([0, *own]), np.zeros(len(z))
    for t in range(deep, len(z)):
        e[t] = z[t] - w[0] - sum(c * z[t - k] for c, k in zip(w[1:], own, strict=False)) - sum(c * e[t - k] for c, k in zip(w[1 + len(own) :], past, strict=True) if t - k >= deep)
    return z, e[deep:], own, past


def moving(seed, n, theta=0.6, phi=0.0):
    e = np.random.default_rng(seed).normal(size=n + 1)
    out = e[1:] + theta * e[:-1]
    for t in range(1, n):
        out[t] += phi * out[t - 1]
    return out


CASES = [((1, 0, 1), (0, 0, 0, 1)), ((0, 1, 2), (0, 0, 0, 1)), ((1, 1, 1), (1, 1, 1, 4)), ((2, 0, 0), (0, 0, 0, 1))]


@pytest.mark.parametrize("spec,seasonal", CASES[1:4:2])
def test_the_fit_is_a_least_sum_of_squares(spark, spec, seasonal):
    y = np.cumsum(moving(4, 150)) * 0.2 + np.sin(np.arange(150) * np.pi / 2)
    df = table(spark, {"a": y})
    row = arma_likelihood.fit(df, "y", "t", ["s"], spec, seasonal).first()
    w = np.array([row.intercept, *row.ar, *row.ma])
    sse = lambda v: float(np.sum(residuals(y, v, spec, seasonal)[1] ** 2))
    assert row.converged and row.sse == pytest.approx(sse(w), rel=1e-9) and row.n == len(residuals(y, w, spec, seasonal)[1])
    for i in range(len(w)):
        for shift in (-1e-3, 1e-3):
            moved = w.copy()
            moved[i] += shift
            assert sse(moved) >= row.sse
    n, k = row.n, len(w) + 1
    loglik = -n / 2 * (np.log(2 * np.pi * row.sse / n) + 1)
    assert (row.loglik, row.aic, row.bic) == pytest.approx((loglik, 2 * k - 2 * loglik, k * np.log(n) - 2 * loglik))
    two = arma.fit(df, "y", "t", ["s"], spec, seasonal, long_order=9)[0].first()
    assert row.sse <= sse(np.array([two.intercept, *two.ar, *two.ma])) + 1e-9


@pytest.mark.parametrize("rows", [1, 3, 40])
@pytest.mark.parametrize("spec,seasonal", CASES)
def test_maps_of_blocks_lead_to_the_residuals_of_the_whole(spec, seasonal, rows):
    y = np.cumsum(moving(4, 90)) * 0.2
    s = arma_likelihood.shape(spec, seasonal, "c")
    w = np.linspace(0.3, -0.2, s.size)
    state, total = np.zeros((s.memory, 2 + s.regressors)), 0.0
    for at in range(0, len(y), rows):
        full = y[max(0, at - s.halo) : at + rows]
        total = total + arma_likelihood.gather(full, w, state, s)
        state = arma_likelihood.advance(state, arma_likelihood.respond(full, w, s), s)
    e = lambda v: residuals(y, v, spec, seasonal)[1]
    j = np.column_stack([(e(w + h) - e(w - h)) / 2e-6 for h in 1e-6 * np.eye(s.size)])
    want = [len(j), e(w) @ e(w), *(j.T @ j)[np.triu_indices(s.size)], *(j.T @ e(w))]
    assert total == pytest.approx(np.array(want), rel=1e-5, abs=1e-5)
    assert state[:, 0] == pytest.approx(e(w)[len(j) - s.memory :])


def test_blocks_change_nothing_and_forecasts_go_on_from_the_residuals(spark):
    spec, seasonal = CASES[2]
    many = {"a": np.cumsum(moving(5, 60)), "b": np.cumsum(moving(6, 45, -0.4))}
    df = table(spark, many)
    whole = {r.s: r for r in arma_likelihood.fit(df, "y", "t", ["s"], spec, seasonal, rounds=3).collect()}
    for r in arma_likelihood.fit(df, "y", "t", ["s"], spec, seasonal, rounds=3, block_rows=16).collect():
        assert [r.sse, r.intercept, *r.ar, *r.ma] == pytest.approx([whole[r.s].sse, whole[r.s].intercept, *whole[r.s].ar, *whole[r.s].ma], rel=1e-6, abs=1e-6)
    got = {(r.s, r.step): r.yhat for r in arma_likelihood.forecast(df, "y", "t", ["s"], 4, spec, seasonal, rounds=3, block_rows=16).collect()}
    (_, d, _), (_, sd, _, m) = spec, seasonal
    for name, y in many.items():
        w = [whole[name].intercept, *whole[name].ar, *whole[name].ma]
        z, e, own, past = residuals(y, w, spec, seasonal)
        level, z, e = list(y), list(z), list(e)
        for step in range(1, 5):
            v = w[0] + sum(c * z[-k] for c, k in zip(w[1:], own, strict=False)) + sum(c * e[-k] for c, k in zip(w[1 + len(own) :], past, strict=True))
            u = v + (level[-1] if d else 0) + (level[-m] if sd else 0) - (level[-m - 1] if d and sd else 0)
            level.append(u), z.append(v), e.append(0.0)
            assert got[name, step] == pytest.approx(u, rel=1e-5, abs=1e-5)


def test_a_series_without_a_key_and_the_route_by_name(spark):
    y = moving(7, 600, 0.5)
    alone = arma_likelihood.fit(table(spark, {"a": y}), "y", "t", [], (0, 0, 1), block_rows=250).first()
    assert alone.ma[0] == pytest.approx(0.5, abs=0.1) and alone.converged
    routed = timeseries.arima(table(spark, {"a": y[:40]}), "y", "t", ["s"], 2, (1, 0, 0), backend="likelihood").collect()
    assert [(r.step, r.fitted, r.ignored) for r in routed] == [(1, "(1,0,0)", ""), (2, "(1,0,0)", "")]


def test_empty_short_constant_and_null_rows(spark):
    empty = table(spark, {"a": []})
    assert arma_likelihood.fit(empty, "y", "t", ["s"], (1, 0, 1)).count() == 0
    assert arma_likelihood.forecast(empty, "y", "t", [], 2, (1, 0, 1)).count() == 0
    rows = [("a", i, float(v)) for i, v in enumerate(moving(8, 60))]
    holes = [(None, 1, 2.0), ("a", None, 5.0), ("a", 7, None), ("a", 8, float("nan")), ("b", 1, 1.0), *(("c", i, 4.0) for i in range(20))]
    make = lambda r: spark.createDataFrame(r, "s string, t int, y double")
    clean = arma_likelihood.fit(make(rows), "y", "t", ["s"], (1, 0, 1), rounds=4).first()
    mixed = {r.s: r for r in arma_likelihood.fit(make(rows + holes), "y", "t", ["s"], (1, 0, 1), rounds=4).collect()}
    assert set(mixed) == {"a", "c"} and mixed["a"].sse == pytest.approx(clean.sse, rel=1e-9) and mixed["c"].sse == pytest.approx(0, abs=1e-3)
    for bad in (((0, 2, 1), "c"), ((0, 1, 0), "n")):
        with pytest.raises(ValueError):
            arma_likelihood.fit(empty, "y", "t", ["s"], bad[0], trend=bad[1])
    with pytest.raises(ValueError):
        arma_likelihood.forecast(empty, "y", "t", ["s"], 0, (1, 0, 1))
