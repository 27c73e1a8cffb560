"""Moving averages, sparse networks, splines and fitted decompositions against NumPy."""

import numpy as np
import pytest

from quern.operators import arma, decomposition, sparse_var, splines, timeseries
from quern.plans import fitted_queries


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "s string, t int, y double")


def two_stage(y, spec, seasonal, long, horizon):
    (p, d, q), (sp, sd, sq, m) = spec, seasonal
    z = y.copy()
    z = z[m:] - z[:-m] if sd else z
    z = np.diff(z) if d else z
    a = np.column_stack([np.ones(len(z) - long), *(z[long - k : len(z) - k] for k in range(1, long + 1))])
    w = np.linalg.lstsq(a.T @ a + 1e-8 * np.eye(long + 1), a.T @ z[long:], rcond=None)[0]
    e, z = z[long:] - a @ w, z[long:]
    own, past = sorted({*range(1, p + 1), *(m * i for i in range(1, sp + 1))}), sorted({*range(1, q + 1), *(m * i for i in range(1, sq + 1))})
    deep = max([0, *own, *past])
    a = np.column_stack([np.ones(len(z) - deep), *(z[deep - k : len(z) - k] for k in own), *(e[deep - k : len(z) - k] for k in past)])
    w = np.linalg.lstsq(a.T @ a + 1e-8 * np.eye(a.shape[1]), a.T @ z[deep:], rcond=None)[0]
    level, zs, es, out = list(y), list(z), list(e), []
    for _ in range(horizon):
        v = w[0] + sum(c * zs[-k] for c, k in zip(w[1:], own, strict=False)) + sum(c * es[-k] for c, k in zip(w[1 + len(own) :], past, strict=True))
        u = v + (level[-1] if d else 0) + (level[-m] if sd else 0) - (level[-m - 1] if d and sd else 0)
        for held, x in ((level, u), (zs, v), (es, 0.0), (out, u)):
            held.append(x)
    return w, out


@pytest.mark.parametrize("spec,seasonal", [((1, 0, 1), (0, 0, 0, 1)), ((0, 1, 2), (0, 0, 0, 1)), ((1, 1, 1), (1, 1, 1, 4)), ((2, 0, 0), (0, 0, 0, 1))])
def test_moving_averages_by_brute_force(spark, spec, seasonal):
    rng = np.random.default_rng(4)
    e = rng.normal(size=160)
    y = np.cumsum(e[1:] + 0.6 * e[:-1]) * 0.2 + np.sin(np.arange(159) * np.pi / 2)
    _, want = two_stage(y, spec, seasonal, 7, 5)
    got = arma.forecast(series(spark, y), "y", "t", ["s"], 5, spec, seasonal, long_order=7).orderBy("step").collect()
    assert [r.yhat for r in got] == pytest.approx(want, rel=1e-6)
    assert {(r.fitted, r.ignored) for r in got} == {(arma.orders(spec, seasonal), "")}


def test_a_moving_average_is_recovered_with_and_without_a_key(spark):
    rng = np.random.default_rng(9)
    e = rng.normal(size=4001)
    y = e[1:] + 0.5 * e[:-1]
    keyed, _ = arma.fit(series(spark, y), "y", "t", ["s"], (0, 0, 1), long_order=8)
    alone, _ = arma.fit(series(spark, y), "y", "t", [], (0, 0, 1), long_order=8)
    a, b = keyed.first(), alone.first()
    assert a.ma[0] == pytest.approx(0.5, abs=0.05) and a.n == 4000 - 8 - 1
    assert (b.ma[0], b.intercept) == pytest.approx((a.ma[0], a.intercept), rel=1e-6)
    out = arma.forecast(series(spark, y), "y", "t", [], 2, (0, 0, 1), long_order=8).orderBy("step").collect()
    assert out[1].yhat == pytest.approx(a.intercept, rel=1e-6)


def test_orders_that_are_fitted_and_ignored(spark):
    y = np.sin(np.arange(60)) + 0.01 * np.arange(60)
    plain = timeseries.arima(series(spark, y), "y", "t", ["s"], 1, (1, 1, 2)).first()
    full = timeseries.arima(series(spark, y), "y", "t", ["s"], 1, (1, 1, 2), backend="two_stage").first()
    assert (plain.fitted, plain.ignored) == ("(1,1,0)", "(0,0,2)") and (full.fitted, full.ignored) == ("(1,1,2)", "")
    with pytest.raises(ValueError):
        arma.forecast(series(spark, y), "y", "t", ["s"], 1, (0, 2, 1))
    with pytest.raises(ValueError):
        arma.fit(series(spark, y), "y", "t", ["s"], (0, 1, 0), trend="n")
    assert arma.forecast(series(spark, []), "y", "t", ["s"], 2, (1, 0, 1)).count() == 0


def planted(n=3000, k=5):
    rng = np.random.default_rng(1)
    a = np.zeros((k, k))
    a[0, 1], a[2, 0], a[3, 3], a[4, 2] = 0.7, -0.6, 0.5, 0.4
    x = np.zeros((n, k))
    for t in range(1, n):
        x[t] = a @ x[t - 1] + rng.normal(size=k)
    return a, x


def test_a_planted_network_is_found(spark):
    a, x = planted()
    names = [f"v{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "t int, " + ", ".join(f"{n} double" for n in names))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    past, now, n, k, l1 = z[:-1], z[1:], len(z) - 1, 5, 0.02
    b = np.zeros((k, k))
    step = 1 / (2 / (n * k) * np.linalg.eigvalsh(past.T @ past)[-1])
    for _ in range(4000):  # plain proximal steps on the rows themselves
        g = b - step * 2 / (n * k) * (past @ b.T - now).T @ past
        b = np.sign(g) * np.maximum(np.abs(g) - step * l1, 0)
    rows = sparse_var.network(df, names, "t", l1=l1).collect()
    got = np.zeros((k, k))
    for r in rows:
        got[int(r.effect[1]), int(r.cause[1])] = r.coefficient
    assert np.abs(got - b).max() < 1e-6
    assert ((got != 0) == (a != 0)).all()
    left = past @ b.T - now
    assert rows[0].mse == pytest.approx((left**2).mean(), rel=1e-6) and rows[0].r2 == pytest.approx(1 - (left**2).sum() / (now**2).sum(), rel=1e-6)


def test_networks_by_series_and_of_little(spark):
    _, x = planted(200, 5)
    both = [(s, i, *map(float, r)) for s, part in (("a", x[:100]), ("b", x[100:])) for i, r in enumerate(part)]
    df = spark.createDataFrame(both, "s string, t int, " + ", ".join(f"v{i} double" for i in range(5)))
    m = sparse_var.moments(df, ["v0", "v1"], "t", ["s"])
    assert m.n == 198  # no step from one series to the other
    flat = spark.createDataFrame([(i, 1.0, None) for i in range(5)], "t int, a double, b double")
    assert sparse_var.network(flat, ["a", "b"], "t").count() == 0
    with pytest.raises(ValueError):
        sparse_var.moments(df, [], "t")


def test_spline_columns_are_a_basis(spark):
    s = splines.Spline("x", -1.0, 3.0, 6)
    x = np.linspace(-2, 4, 61)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = np.array([list(r) for r in df.select(*s.columns(df.x)).collect()])
    assert np.allclose(got, s.values(x)) and got.shape == (61, 7)
    inside = (x >= -1) & (x <= 1)  # where the function left out is zero, the others sum to 1
    assert np.allclose(got[inside].sum(axis=1), 1) and (got >= -1e-12).all()
    assert np.allclose(got[x < -1], got[np.argmin(np.abs(x + 1))])


def test_cross_validation_equals_refits(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (400, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + rng.normal(0, 0.1, 400)
    fold = np.arange(400) % 5
    df = spark.createDataFrame([(int(f), *map(float, r), float(v)) for f, r, v in zip(fold, x, y, strict=True)], "f int, a double, b double, y double")
    sums = splines.fold_sums(df, [df.a, df.b, df.a * df.b], df.y, df.f)
    alpha, error, w = splines.cross_validate(sums, (0.1, 10.0))
    design = np.column_stack([x, x[:, 0] * x[:, 1]])

    def ridge(d, t, a):
        m, u = d.mean(axis=0), t.mean()
        c = np.linalg.solve((d - m).T @ (d - m) + a * np.eye(3), (d - m).T @ (t - u))
        return np.concatenate([[u - m @ c], c])

    for a in (0.1, 10.0):
        out = sum(((y[fold == f] - (lambda v, f=f: v[0] + design[fold == f] @ v[1:])(ridge(design[fold != f], y[fold != f], a))) ** 2).sum() for f in range(5))
        assert error[a] == pytest.approx(out / 400, rel=1e-9)
    assert w == pytest.approx(ridge(design, y, alpha), rel=1e-9)
    with pytest.raises(ValueError):
        splines.cross_validate({0: sums[0]})


def test_fold_sums_work_out_bases_in_tasks(spark):
    """A column and its basis functions, worked out in tasks, have the sums of the same functions as columns."""
    df = spark.createDataFrame([(i % 3, float(i % 17) / 2, float(i % 5), float(i * i % 23)) for i in range(200)] + [(0, None, 1.0, 1.0)], "f int, a double, b double, y double")
    for degree in (1, 2, 3):
        s = splines.Spline("a", 0.0, 8.0, 6, degree)
        got = splines.fold_sums(df, [df.a, df.b], df.y, df.f, [s, None])
        want = splines.fold_sums(df, [df.a, df.b, *s.columns(df.a), df.b], df.y, df.f)
        assert got.keys() == want.keys() == {0, 1, 2}
        for f in want:
            assert got[f].n == want[f].n and got[f].x == pytest.approx(want[f].x, abs=1e-9) and got[f].xx == pytest.approx(want[f].xx, abs=1e-8)


def test_curves_are_told_from_lines(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, (3000, 2))
    flag = rng.integers(0, 2, 3000)
    y = np.cos(3 * x[:, 0]) + 2 * x[:, 1] + flag
    df = spark.createDataFrame([(i, float(a), float(b), int(c), float(d)) for i, ((a, b), c, d) in enumerate(zip(x, flag, y, strict=True))], "i int, wave double, line double, flag int, y double")
    got = {r.feature: r for r in splines.linearity(df, ["wave", "line", "flag"], df.y, df.i % 4, knots=12).collect()}
    assert got["wave"].nonlinear and not got["line"].nonlinear and got["flag"].kind == "few values"
    assert got["line"].spline_rmse < 0.2 < got["line"].linear_rmse


def test_decomposition_goes_on_after_the_fit(spark):
    season = np.array([2.0, -1.0, 0.5, -1.5])
    y = 0.1 * np.arange(44) + np.tile(season, 11)
    fitted = decomposition.SeasonalDecomposition("y", "t", ["s"], 4).fit(series(spark, y[:40]).unionByName(series(spark, y[:6], "short")))
    new = series(spark, y[40:]).unionByName(series(spark, [1.0], "short")).unionByName(series(spark, [1.0], "other"))
    got = {(r.s, r.t): r for r in fitted.transform(new).collect()}
    state = {(r.s, r.phase): r.seasonal for r in fitted.state.collect()}
    for k in range(4):
        row = got["s", k]
        assert row.seasonal == state["s", k] and row.seasonal + row.trend + row.resid == pytest.approx(y[40 + k])
    assert got["short", 0].resid is None and got["other", 0].trend is None
    with pytest.raises(ValueError):
        decomposition.SeasonalDecomposition("y", "t", ["s"], 4).transform(new)


def test_history_is_aligned_by_place(spark):
    known = spark.createDataFrame([("a", 1, 1.0, 10), ("a", 2, 2.0, 20), ("a", 3, 3.0, 30), ("b", 1, 5.0, 50), ("c", 7, 1.0, 70), ("d", 1, None, 80)], "s string, t int, y double, x int")
    history = spark.createDataFrame([("a", 100, 1.0), ("a", 101, 2.0), ("b", 1, 6.0), ("c", 1, 9.0), ("c", 2, 9.0), ("d", 1, None), ("e", 1, 1.0)], "s string, t int, y double")
    got = [(r.s, r.t, r.x, r.match) for r in decomposition.align_history(history, known, "y", "t", ["s"], ["x"]).orderBy("s", "t").collect()]
    assert got == [("a", 100, 10, "prefix"), ("a", 101, 20, "prefix"), ("b", 1, 50, "length"), ("c", 1, None, "none"), ("c", 2, None, "none"), ("d", 1, 80, "length"), ("e", 1, None, "none")]


def test_sparse_network_query_equals_numpy(spark, sf_dir):
    wide = fitted_queries._brand_table(spark, sf_dir).orderBy("d").toPandas().drop(columns="d")
    x = wide[sorted(wide.columns)].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    m = sparse_var.Moments(sorted(wide.columns), len(z) - 1, z[:-1].T @ z[:-1], z[1:].T @ z[:-1], (z[1:] ** 2).sum(axis=0))
    a = sparse_var.solve(m, 0.0005)
    got = {(r.effect, r.cause): r.coefficient for r in fitted_queries.sparse_network(spark, sf_dir).collect()}
    want = {(m.names[i], m.names[j]): round(float(v), 5) for (i, j), v in np.ndenumerate(a) if v != 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in got)
