"""Quantiles, moments, forecasts, tests and preparation against NumPy and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import conditional as C
from quern.functions import distributions as D
from quern.functions import expressions as X
from quern.functions import primitives as P
from quern.operators import catalog, guards, linear, metrics, moments, panel, pool, prep, presets, quantiles, text, timeseries
from quern.plans import feature_queries, measure_queries


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("values", [[], [4.0], [3.0, 1.0, 2.0], [1.0] * 7 + [9.0], list(np.random.default_rng(2).normal(size=301))])
def test_quantiles_like_numpy(spark, values):
    df = frame(spark, [(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    got = quantiles.quantiles(df, F.col("v"), [0.0, 0.1, 0.5, 0.95, 1.0]).first()["q"]
    assert got == ([None] * 5 if not values else pytest.approx(np.quantile(values, [0.0, 0.1, 0.5, 0.95, 1.0]).tolist()))


def table(spark, seed=3, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 100, 1e-3, 1] + [5, -1e6, 0, 2]
    x[:, 3] = 2 * x[:, 0] + 0.1 * x[:, 3]
    rows = [tuple(None if rng.random() < 0.05 else float("inf") if rng.random() < 0.02 else float(v) for v in r) for r in x]
    return rows, frame(spark, rows, "a double, b double, c double, d double").repartition(3)


def test_correlations_like_numpy(spark):
    rows, df = table(spark)
    got = {(r.i, r.j): r.corr for r in moments.correlations(df, [F.col(c) for c in "abcd"] + [F.lit(1.0)]).collect()}
    x = np.array([[np.nan if v is None else v for v in r] + [1.0] for r in rows])
    for i, j in itertools.combinations(range(5), 2):
        both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
        want = 0.0 if j == 4 else np.corrcoef(x[both][:, i], x[both][:, j])[0, 1]
        assert got[i, j] == pytest.approx(want, abs=1e-9)


def test_correlations_of_nothing(spark):
    df = frame(spark, [], "a double, b double")
    assert [r.corr for r in moments.correlations(df, [F.col("a"), F.col("b")]).collect()] in ([0.0], [])


@pytest.mark.parametrize("columns,rank", [("abd", 3), ("aad", 2), ("a", 1)])
def test_basis_metrics_like_numpy(spark, columns, rank):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ np.diag([1, 5, 2]) + 7
    df = frame(spark, [tuple(map(float, r)) for r in x], "a double, b double, d double")
    m = x[:, ["abd".index(c) for c in columns]]
    got = moments.basis_metrics(df, [F.col(c) for c in columns]).first()
    centred = m - m.mean(axis=0)
    assert got.rank == rank == np.linalg.matrix_rank(centred)
    off = np.abs(np.atleast_2d(np.corrcoef(m, rowvar=False)) - np.eye(len(columns)))
    assert got.max_abs_corr == pytest.approx(off.max(), abs=1e-9)
    assert got.mean_abs_corr == pytest.approx(off.sum() / max(1, off.size - len(columns)), abs=1e-9)
    if rank == len(columns):
        assert got.condition == pytest.approx(np.linalg.cond(centred), rel=1e-6)
    else:
        assert got.condition == 1e12


def test_prune_redundant_by_brute_force(spark, sf_dir):
    x = feature_queries._x(spark, sf_dir)
    terms = pool.candidates(["a", "b"])
    data = np.array([tuple(r) for r in x.select(*(t[4] for t in terms), "t").collect()], float)
    corr = np.nan_to_num(np.corrcoef(data, rowvar=False))
    order = sorted(range(len(terms)), key=lambda i: (-abs(corr[i, -1]), terms[i][2], terms[i][0]))
    kept = []
    for i in order:
        if all(abs(corr[i, k]) < 0.95 for k in kept):
            kept.append(i)
    got = {r.name for r in feature_queries.QUERIES["t9_prune_redundant"](spark, sf_dir).collect()}
    assert got == {terms[i][0] for i in kept}


def brute_f(y, x, lag):
    n = len(y)
    design = np.column_stack([np.ones(n - lag), *(y[lag - k : n - k] for k in range(1, lag + 1))])
    both = np.column_stack([design, *(x[lag - k : n - k] for k in range(1, lag + 1))])
    ssr = [((y[lag:] - d @ np.linalg.lstsq(d, y[lag:], rcond=None)[0]) ** 2).sum() for d in (design, both)]
    free = n - lag - 2 * lag - 1
    return (ssr[0] - ssr[1]) / lag / (ssr[1] / free), free


def tail_by_sum(f, d1, d2):
    """P(F > f) by integrating the density with many steps."""
    t = np.linspace(0, f, 400_001)[1:] - f / 800_000
    log = d1 / 2 * math.log(d1 / d2) + (d1 / 2 - 1) * np.log(t) - (d1 + d2) / 2 * np.log1p(d1 * t / d2)
    norm = math.lgamma(d1 / 2) + math.lgamma(d2 / 2) - math.lgamma((d1 + d2) / 2)
    return 1 - np.exp(log - norm).sum() * (f / 400_000)


@pytest.mark.parametrize("by", [[], ["s"]])
def test_granger_by_brute_force(spark, by):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for s in ("u", "v") if by else ("u",):
        x, y = rng.normal(size=120), np.zeros(120)
        for i in range(2, 120):
            y[i] = 0.3 * y[i - 1] + 0.6 * x[i - 2] + rng.normal()
        rows += [(s, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
        for lag in (1, 2, 3):
            want[s, "x", lag], want[s, "y", lag] = brute_f(y, x, lag), brute_f(x, y, lag)
    df = frame(spark, rows + [("u", 999, None, 1.0)], "s string, i int, x double, y double").repartition(4)
    tests = timeseries.granger(df, [("x", "y"), ("y", "x")], "i", 3, by)
    for r in tests.collect():
        f, free = want[r.s if by else "u", r.cause, r.lag]
        assert r.f_statistic == pytest.approx(f, rel=1e-8)
        if r.lag > 1:
            assert r.p_value == pytest.approx(tail_by_sum(f, r.lag, free), abs=1e-6)
    best = {r.cause: (r.lag, r.significant) for r in timeseries.best_lags(tests, [*by, "cause", "effect"]).collect()}
    assert best["x"] == (2, True)


def test_granger_query_by_brute_force(spark, sf_dir):
    wide = measure_queries._wide(spark, sf_dir).orderBy("d").toPandas()
    found = measure_queries.QUERIES["w32_granger"](spark, sf_dir).collect()
    assert len(found) == 6 * 3
    for r in found:
        pair = wide.dropna(subset=[r.cause, r.effect])
        f, _ = brute_f(pair[r.effect].to_numpy(), pair[r.cause].to_numpy(), r.lag)
        assert r.f_statistic == pytest.approx(f, abs=1e-3)


def test_f_tail_of_one_degree():
    # F(1, n) is a squared t; with n = 1 that is Cauchy's.
    for f in (0.1, 1.0, 7.0, 1e4):
        assert timeseries._f_tail(f, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(f)), abs=1e-12)
    assert timeseries._f_tail(0.0, 2, 3) == 1.0


def series(spark, values, name="s"):
    return frame(spark, [(name, i, float(v)) for i, v in enumerate(values)], "s string, t int, y double")


def test_arima_of_a_trend(spark):
    got = timeseries.arima(series(spark, range(40)), "y", "t", ["s"], 3, (1, 1, 0)).orderBy("step").collect()
    assert [r.yhat for r in got] == pytest.approx([40, 41, 42], abs=1e-4)


@pytest.mark.parametrize("spec,seasonal", [((2, 0, 0), (0, 0, 0, 1)), ((1, 1, 1), (0, 0, 0, 1)), ((1, 0, 0), (1, 1, 0, 4)), ((0, 1, 0), (1, 1, 0, 4)), ((0, 0, 0), (0, 1, 0, 4))])
def test_arima_by_brute_force(spark, spec, seasonal):
    rng = np.random.default_rng(8)
    y = np.cumsum(rng.normal(size=60)) + 3 * np.sin(np.arange(60) * math.pi / 2)
    (p, d, _), (sp, sd, _, m) = spec, seasonal
    z = np.diff(y) if d else y.copy()
    z = z[m:] - z[:-m] if sd else z
    lags = [*range(1, p + 1), *(m * i for i in range(1, sp + 1))]
    deep = max([*lags, 0])
    design = np.column_stack([np.ones(len(z) - deep), *(z[deep - k : len(z) - k] for k in lags)])
    w = np.linalg.solve(design.T @ design + 1e-8 * np.eye(design.shape[1]), design.T @ z[deep:])
    level, steps, want = list(y), list(z), []
    for _ in range(5):
        v = w[0] + sum(c * steps[-k] for c, k in zip(w[1:], lags, strict=True))
        u = v + (level[-1] if d else 0) + (level[-m] if sd else 0) - (level[-m - 1] if d and sd else 0)
        level.append(u)
        steps.append(v)
        want.append(u)
    got = timeseries.arima(series(spark, y), "y", "t", ["s"], 5, spec, seasonal).orderBy("step").collect()
    assert [r.yhat for r in got] == pytest.approx(want, rel=1e-6)


def test_arima_with_exogenous_columns(spark):
    x = np.sin(np.arange(50))
    df = frame(spark, [("s", i, 2.0 + 3 * x[i].item(), x[i].item()) for i in range(50)], "s string, t int, y double, x double")
    future = frame(spark, [("s", 1, 0.5), ("s", 2, -1.0)], "s string, step int, x double")
    got = timeseries.arima(df, "y", "t", ["s"], 2, (0, 0, 0), exogenous=["x"], future=future).orderBy("step").collect()
    assert [r.yhat for r in got] == pytest.approx([3.5, -1.0], abs=1e-5)
    with pytest.raises(ValueError):
        timeseries.arima(df, "y", "t", ["s"], 2, exogenous=["x"])
    with pytest.raises(ValueError):
        timeseries.arima(df, "y", "t", ["s"], 2, (0, 2, 0))
    with pytest.raises(ValueError):
        timeseries.arima(df, "y", "t", ["s"], 2, backend="other")


def test_lag_estimator_and_holdout(spark):
    from pyspark.ml.regression import LinearRegression

    both = series(spark, [2.0**i for i in range(12)], "u").unionByName(series(spark, [3 * 2.0**i for i in range(12)], "v"))
    fit = lambda history, h: timeseries.LagEstimator(LinearRegression(regParam=0.0, solver="normal"), "y", "t", ["s"], [1]).fit(history).forecast(history, h)
    got = {(r.s, r.step): r.yhat for r in fit(both, 2).collect()}
    assert got == pytest.approx({("u", 1): 4096, ("u", 2): 8192, ("v", 1): 12288, ("v", 2): 24576}, rel=1e-6)
    out = {r.s: r for r in timeseries.holdout(both, "y", "t", ["s"], 3, fit).collect()}
    assert out["u"].rmse == pytest.approx(0, abs=1e-4) and out["u"].mase == pytest.approx(0, abs=1e-6)


def test_mase_on_a_flat_history(spark):
    df = frame(spark, [("a", 1.0, 1.0), ("b", 1.0, 2.0)], "g string, y double, p double")
    got = {r.g: r.mase for r in metrics.forecast(df, "y", "p", F.lit(0.0), ["g"]).collect()}
    assert got == {"a": 0.0, "b": math.inf}


def test_erf_and_gaussian_scores(spark):
    xs = [0.0, 1e-9, -0.3, 0.9, 2.5, -4.0, 5.9, 30.0, -30.0]
    got = [r[0] for r in frame(spark, [(x,) for x in xs], "x double").select(D.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(x) for x in xs], abs=1e-14)
    # The score of a normal prediction is the integral of the squared gap of the distribution functions.
    df = frame(spark, [(0.7, 0.2, 1.5)], "y double, m double, s double")
    t = np.linspace(-12, 12, 200_001)
    cdf = np.array([0.5 * (1 + math.erf((v - 0.2) / 1.5 / math.sqrt(2))) for v in t[::100]])
    want = np.trapezoid((cdf - (t[::100] >= 0.7)) ** 2, t[::100])
    assert metrics.gaussian(df, "y", "m", "s").first()["crps"] == pytest.approx(want, abs=5e-3)


def test_parameters_start_from_one_and_clamp_only_when_bound(spark):
    p = {"type": "param", "name": "w", "lower": 0.0, "upper": 2.0}
    df = frame(spark, [(3.0,)], "x double")
    e = X.bi("mul", p, X.feature(0))
    assert df.select(X.to_column(e, [F.col("x")])).first()[0] == 3.0
    assert df.select(X.to_column(e, [F.col("x")], {"w": 9.0})).first()[0] == 27.0
    assert X.bind([e], [9.0]) == {"w": 2.0}
    with pytest.raises(ValueError):
        X.bind([e, {**p, "init": 3.0}], [1.0])
    with pytest.raises(ValueError):
        X.bind([e], [])


def test_conditional_modes(spark):
    df = frame(spark, [(-2.0,), (3.0,)], "x double")
    want = {"identity": [-2, 3], "off": [0, 0], "abs": [2, 3], "sq": [4, 9], "neg": [2, -3], "relu": [0, 3], "left_hinge": [2, 0], "unknown": [-2, 3]}
    for mode, values in want.items():
        assert [r[0] for r in df.select(X.to_column(C.side(mode, X.feature(0)), [F.col("x")])).collect()] == pytest.approx(values)
    plain = C.lower([{"name": "g", "family": "gate_binary", "source": "x"}], ["x"], frozenset("x"))
    assert plain == [("g", X.feature(0), 2.2, [0])]


def test_structure_guard_of_twins(spark):
    """Two equal terms of complexity 30 each: too complex, a duplicate, and redundant."""
    schema = "candidate int, key string, family string, complexity double, features array<int>, stability double, pole_safety double"
    terms = frame(spark, [(1, "k", "other", 30.0, [0], 0.8, 0.8), (1, "k", "other", 30.0, [0], 0.8, 0.05), (2, "z", "seed", 1.0, [0, 1], None, None)], schema)
    pairs = frame(spark, [(1, 1.0)], "candidate int, corr double")
    got = {r.candidate: r for r in guards.structure_guard(terms, pairs, {"max_feature_reuse": 1}).collect()}
    assert list(got[1].reasons) == ["complexity_budget", "seat_duplicate", "feature_reuse", "redundant_values", "pole_safety"]
    assert got[1].penalty == pytest.approx(0.01 * 36 + 0.5 + 0.25 + 0.25 + 0.5 * 0.07)
    assert not got[2].triggered and got[2].bonus == pytest.approx(0.02)


def test_batches_replay_from_a_checkpoint(spark):
    df = spark.range(11)
    make = lambda: prep.BatchSchedule(df, "id", 4, shuffle=True)
    one, ids = make(), lambda b: sorted(r.id for r in b.collect())
    first = [ids(one.next()) for _ in range(4)]
    assert sorted(sum(first[:3], [])) == list(range(11)) and [len(b) for b in first] == [4, 4, 3, 4]
    two = make()
    two.restore({**two.state(), "epoch": 0, "cursor": 2})
    assert [ids(two.next()), ids(two.next())] == first[2:]
    with pytest.raises(ValueError):
        two.restore({**two.state(), "rows": 12})
    with pytest.raises(ValueError):
        two.restore({**two.state(), "cursor": 3})
    with pytest.raises(ValueError):
        prep.BatchSchedule(df.limit(0), "id", 4)


def test_numeric_plan_edges(spark):
    plan = prep.numeric_plan([{"key": "c", "dtype": "string"}, {"key": "f", "dtype": "bool"}], "y")
    df = frame(spark, [("b", None, 1.0), (None, True, 2.0)], "c string, f boolean, y double")
    with pytest.raises(ValueError):
        prep.transform_numeric(df, plan)
    fitted = prep.fit_numeric(df, plan)
    assert [c["name"] for c in fitted] == ["c=", "c=b", "f", "y"]
    assert sorted(tuple(r) for r in prep.transform_numeric(df, fitted).collect()) == [(0.0, 1.0, 0.0, 1.0), (1.0, 0.0, 1.0, 2.0)]
    with pytest.raises(KeyError):
        prep.transform_numeric(df.drop("y"), fitted)
    with pytest.raises(ValueError):
        prep.transform_numeric(df.limit(0), fitted)
    with pytest.raises(ValueError):
        prep.numeric_plan([{"key": "c", "encoder": "odd"}], "y")


def test_token_dataset(spark):
    rows = [(1, "cat sat", 0), (2, "dog sat", 1), (3, "cat ran", 0), (4, "dog ran", None)]
    df = frame(spark, rows, "id int, text string, label int")
    got = {r.id: r for r in text.token_dataset(df, "id", "text", "label", 5, 0.25, 1).collect()}
    assert list(got[1].ids) == [4, 7, 3, 0, 0] and list(got[1].attention_mask) == [1, 1, 1, 0, 0]
    assert got[4].label == 0.0 and [r.split for r in got.values()].count("valid") == 1
    assert {r.split for r in text.token_dataset(df, "id", "text", None, 5).collect()} == {"train"}


def test_names_links_and_tags(spark):
    df = frame(spark, [("HTTPServer2Proxy",), ("--",), (None,), ("a b__c",)], "s string")
    assert [r[0] for r in df.select(text.camel_to_snake(F.col("s"))).collect()] == ["http_server2_proxy", "component", "component", "a_b_c"]
    link = frame(spark, [("/x?a=1&b=%26+c&a=2&=3&d",), ("/x",)], "u string").select(text.query_parameters(F.col("u")))
    assert [r[0] for r in link.collect()] == [{"b": "& c", "a": "2"}, {}]
    assert frame(spark, [(" A, b,,a",), (None,)], "t string").select(text.tag_list(F.col("t"))).collect() == [(["a", "b"],), ([],)]
    assert df.select(text.deep_link("/p", {"q": F.col("s")})).collect()[1:3] == [("/p?q=--",), ("/p",)]


def test_catalog_edges(spark):
    df = frame(spark, [("k1", "a"), ("k2", "b")], "key string, kind string")
    assert catalog.entry(df, "k1").count() == 1
    with pytest.raises(KeyError):
        catalog.entry(df, "zz")
    assert panel.cap_dates(frame(spark, [(i,) for i in range(9)], "d int"), "d", 4, 12, True).agg(F.min("d")).first()[0] == 6


def test_orthogonal_map_like_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 2)) * [1, 3] + [2, -1]
    df = frame(spark, [tuple(map(float, r)) for r in x], "a double, b double")
    wide = linear.expand({"a": F.col("a"), "b": F.col("b")})
    assert list(wide) == ["a", "b", "a^2", "b^2", "a*b"]
    m = np.column_stack([x, x**2, x[:, 0] * x[:, 1]])
    centred = m - m.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    for energy, most in ((0.999, None), (0.5, None), (None, 2)):
        fitted = linear.fit_orthogonal(df, list(wide.values()), energy, most)
        share = np.cumsum(s**2) / (s**2).sum()
        rank = min(len(s) if energy is None else int(np.searchsorted(share, energy) + 1), most or len(s))
        assert len(fitted.components) == rank and fitted.energy == pytest.approx(share[rank - 1])
        got = np.array([tuple(r) for r in df.select(*fitted.columns(list(wide.values()))).collect()])
        assert np.abs(got) == pytest.approx(np.abs(centred @ vt[:rank].T), rel=1e-5, abs=1e-6)


def test_presets(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), float(a > 0.5), bool(i % 4 == 0)) for i, (a, b) in enumerate(rng.random((200, 2)))]
    df = frame(spark, rows, "a double, b double, y double, v boolean")
    for kind in ("logistic", "boosting_classifier"):
        model = presets.fit(df, ["a", "b"], "y", kind, valid="v" if "boost" in kind else None, **({"maxIter": 5, "maxDepth": 2} if "boost" in kind else {}))
        out = presets.predict(model, df)
        assert out.columns == [*df.columns, "prediction"] and out.where("prediction = y").count() > 180
    with pytest.raises(ValueError):
        presets.fit(df, ["a"], "y", "odd")
    with pytest.raises(ValueError):
        presets.fit(df, ["a"], "y", "logistic", valid="v")


def test_pool_update_adds_and_removes(spark):
    rng = np.random.default_rng(7)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(300, 3))]
    df = frame(spark, rows, "a double, b double, c double").withColumn("t", F.sin("a") * F.col("b"))
    start = pool.score(df, pool.candidates(["a", "b", "c"], pairs=False)[:3], "t")
    out, moved = pool.update(df, start, ["a", "b", "c"], F.col("t"), features=3, threshold=0.2, cap=8)
    kept = {r.name: r.prior_corr for r in out.collect()}
    assert 0 < len(kept) <= 8 and max(kept.values()) > 0.9 and all(abs(v) >= 0.2 for v in kept.values())
    before = {r.name for r in start.collect()}
    assert {(r.name, r.change) for r in moved.collect()} == {(n, "added") for n in set(kept) - before} | {(n, "removed") for n in before - set(kept)}


def test_sparsemax_and_edges(spark):
    df = frame(spark, [([0.1, 0.1],), ([5.0, 0.0, 1.0],), ([],)], "v array<double>")
    got = [r[0] for r in df.select(prep.sparsemax(F.col("v"))).collect()]
    assert got == [[0.5, 0.5], [1.0, 0.0, 0.0], []]
    edges = frame(spark, [(1, 2), (1, 2), (1, 1)], "src int, dst int")
    assert {(r.src, r.dst): round(r.weight, 4) for r in prep.normalized_edges(edges).collect()} == {(1, 2): 0.7071, (1, 1): 0.5, (2, 2): 1.0}


def test_predicates_and_checks(spark):
    df = frame(spark, [(1, 0.5, "x")], "k int, a double, s string")
    with pytest.raises(ValueError):
        prep.predicate({"kind": "threshold", "op": "~", "value": 1}, F.col("a"))
    with pytest.raises(ValueError):
        prep.predicate({"kind": "odd"}, F.col("a"))
    with pytest.raises(TypeError, match="s, gone"):
        prep.check_features(df, ["a", "k", "s", "gone"])
    assert prep.annotate(df, {"a": "price"}).schema["a"].metadata == {"group": "price"}
    with pytest.raises(KeyError):
        catalog.require_profile(df.withColumn("profile", F.lit("p")), "q")


def test_conditional_specs(spark):
    df = frame(spark, [(1.0, 2.0), (None, 3.0)], "a double, b double")
    cols = [F.col("a"), F.col("b")]
    got = [tuple(r) for r in df.select(*P.from_spec({"name": "onehot", "params": {"values": [1, 2]}}, cols), *P.from_spec({"kind": "hinge", "feature_index": 1, "knot": 2.5}, cols)).collect()]
    assert got == [(1.0, 0.0, 0.0), (0.0, 0.0, 0.5)]
    with pytest.raises(ValueError):
        P.from_spec("odd", cols)
    names = [t[0] for t in pool.nested(pool.candidates(["a"], pairs=False)[:2])]
    assert names and not any(n.startswith("identity") for n in names)
    assert df.select(P.with_residual(F.col("b"), [])).first()[0] == 2.0
