"""Queries over predictions, series and panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.guards import average_rank
from quern.operators import metrics, panel, prep, timeseries
from quern.plans.tables import BRAND_DAYS, FLAG_DAYS, PREDICTIONS, brand_days, flag_days, predictions, r, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _rounded(df, *keep):
    return df.select(*keep, *(r(c) for c in df.columns if c not in keep))


@query("a8_regression", f"""WITH {PREDICTIONS} SELECT l_returnflag, round(avg((y-yhat)*(y-yhat)), 6) AS mse, round(sqrt(avg((y-yhat)*(y-yhat))), 6) AS rmse,
    round(avg(abs(y-yhat)), 6) AS mae, round(1 - sum((y-yhat)*(y-yhat))/(var_pop(y)*count(y)), 6) AS r2 FROM pred GROUP BY 1""")  # fmt: skip
def regression(spark, sf_dir):
    return _rounded(metrics.regression(predictions(spark, sf_dir), "y", "yhat", ["l_returnflag"]), "l_returnflag")


@query("a9_regression_floor", f"WITH {PREDICTIONS} SELECT round(avg((y-low)*(y-low)), 6) AS mse, round(sqrt(avg((y-low)*(y-low))), 6) AS rmse, round(avg(abs(y-low)), 6) AS mae, round(1 - sum((y-low)*(y-low))/(var_pop(y)*count(y)), 6) AS r2 FROM pred")
def regression_floor(spark, sf_dir):
    return _rounded(metrics.regression(predictions(spark, sf_dir), "y", "low", r2_mode="floor"))


@query("a11_interval", f"""WITH {PREDICTIONS} SELECT round(avg(CASE WHEN y BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(greatest(high-low, 0)), 6) AS mean_width,
    round(avg(greatest(low-y, y-high, 0)), 6) AS mean_miss, round(avg((y-(low+high)/2)*(y-(low+high)/2)), 6) AS center_mse, round(sqrt(avg((y-(low+high)/2)*(y-(low+high)/2))), 6) AS center_rmse FROM pred""")  # fmt: skip
def interval(spark, sf_dir):
    return _rounded(metrics.interval(predictions(spark, sf_dir), "y", "low", "high"))


@query("a13_confusion", f"""WITH {PREDICTIONS}, c AS (SELECT DISTINCT l_returnflag AS class FROM pred UNION SELECT DISTINCT guess FROM pred),
    s AS (SELECT class, (SELECT count(*) FROM pred WHERE l_returnflag = class AND guess = class) AS tp, (SELECT count(*) FROM pred WHERE l_returnflag = class) AS sup, (SELECT count(*) FROM pred WHERE guess = class) AS pp FROM c)
    SELECT class, round(tp/pp, 6) AS precision, round(tp/sup, 6) AS recall, round(2*(tp/pp)*(tp/sup)/((tp/pp)+(tp/sup)), 6) AS f1, sup AS support FROM s""")  # fmt: skip
def confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), "l_returnflag", "guess").select("class", r("precision"), r("recall"), r("f1"), "support")


@query("a12_macro", f"""WITH {PREDICTIONS}, c AS (SELECT DISTINCT l_returnflag AS class FROM pred),
    s AS (SELECT class, (SELECT count(*) FROM pred WHERE l_returnflag = class AND guess = class) AS tp, (SELECT count(*) FROM pred WHERE l_returnflag = class) AS sup, (SELECT count(*) FROM pred WHERE guess = class) AS pp FROM c)
    SELECT round(avg(tp/pp), 6) AS macro_precision, round(avg(tp/sup), 6) AS macro_recall, round(avg(2*(tp/pp)*(tp/sup)/((tp/pp)+(tp/sup))), 6) AS macro_f1 FROM s""")  # fmt: skip
def macro(spark, sf_dir):
    return _rounded(metrics.macro(predictions(spark, sf_dir), "l_returnflag", "guess"))


@query("a12_binary", f"""WITH {PREDICTIONS}, z AS (SELECT label, score AS p, greatest(least(score, 1-1e-12), 1e-12) AS q FROM pred),
    s AS (SELECT avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS acc, avg(-CASE WHEN label = 1 THEN ln(q) ELSE ln(1-q) END) AS ll,
        sum(CASE WHEN p >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS pp, sum(label) AS np FROM z)
    SELECT round(acc, 6) AS accuracy, round(1-acc, 6) AS error, round(ll, 6) AS log_loss, round(tp/pp, 6) AS precision, round(tp/np, 6) AS recall, round(2*(tp/pp)*(tp/np)/(tp/pp+tp/np), 6) AS f1 FROM s""")  # fmt: skip
def binary(spark, sf_dir):
    return _rounded(metrics.binary_classification(predictions(spark, sf_dir), "label", "score"))


@query("a14_roc_auc", f"""WITH {PREDICTIONS}, k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM pred),
    s AS (SELECT sum(CASE WHEN label = 1 THEN rk END) AS sr, sum(label) AS np, count(*) - sum(label) AS nn FROM k) SELECT round((sr - np*(np+1)/2) / (np*nn), 6) AS roc_auc FROM s""")  # fmt: skip
def roc_auc(spark, sf_dir):
    return _rounded(metrics.roc_auc(predictions(spark, sf_dir), "label", "score"))


@query("a15_average_precision", f"""WITH {PREDICTIONS}, k AS (SELECT label, row_number() OVER w AS rk, sum(label) OVER w AS tp FROM pred
        WINDOW w AS (ORDER BY score DESC, l_orderkey * 8 + l_linenumber ROWS UNBOUNDED PRECEDING))
    SELECT round(sum(CASE WHEN label = 1 THEN tp / rk END) / sum(label), 6) AS average_precision FROM k""")  # fmt: skip
def average_precision(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return _rounded(metrics.average_precision(p, "label", "score", "id"))


@query("a16_forecast", f"""WITH {FLAG_DAYS}, s AS (SELECT y, lag(y) OVER (PARTITION BY series ORDER BY d) AS p, abs(y - lag(y) OVER (PARTITION BY series ORDER BY d)) AS step FROM days)
    SELECT round(avg((p-y)*(p-y)), 6) AS mse, round(avg(abs(p-y)), 6) AS mae, round(avg(abs(p-y)/greatest(abs(y), 1e-12)), 6) AS mape, round(avg(2*abs(p-y)/greatest(abs(y)+abs(p), 1e-12)), 6) AS smape,
    round(avg(p-y), 6) AS bias, round(sqrt(avg((p-y)*(p-y))), 6) AS rmse FROM s WHERE p IS NOT NULL""")  # fmt: skip
def forecast(spark, sf_dir):
    days = flag_days(spark, sf_dir)
    rows = days.withColumn("p", F.lag("y").over(Window.partitionBy("series").orderBy("d"))).where("p is not null")
    return _rounded(metrics.forecast(rows, "y", "p"))


@query("a16_mase", f"""WITH {PREDICTIONS}, e AS (SELECT l_returnflag, avg(abs(yhat-y)) AS mae FROM pred GROUP BY 1) SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN round(mae / 2, 6) ELSE CAST('inf' AS DOUBLE) END AS mase FROM e""")
def mase(spark, sf_dir):
    """In units of a naive error of 2 for one group and of 0 for the others."""
    scale = F.when(F.col("l_returnflag") == "A", 2.0).otherwise(0.0)
    return metrics.forecast(predictions(spark, sf_dir), "y", "yhat", scale, ["l_returnflag"]).select("l_returnflag", r("mase"))


@query("a17_naive_scale", f"WITH {FLAG_DAYS}, s AS (SELECT series, abs(y - lag(y, 7) OVER (PARTITION BY series ORDER BY d)) AS m FROM days) SELECT series, round(avg(m), 6) AS scale FROM s GROUP BY 1")
def naive_scale(spark, sf_dir):
    return metrics.naive_scale(flag_days(spark, sf_dir), "y", "d", ["series"], 7).select("series", r("scale"))


def _sql_erf(x: str) -> str:
    """The series of the error function, term by term."""
    total = "1.0"
    for n in range(110, 0, -1):
        total = f"(1 + 2*m*m/{2 * n + 1}.0*{total})"
    return f"(SELECT sign(v)*least(2/sqrt(pi())*m*exp(-m*m)*{total}, 1.0) FROM (SELECT v, least(abs(v), 6.0) AS m FROM (SELECT {x} AS v)))"


@query("a18_gaussian", f"""WITH {PREDICTIONS}, z AS (SELECT y, yhat, (y-yhat)/10 AS z FROM pred), e AS (SELECT *, {_sql_erf('z/sqrt(2.0)')} AS e FROM z)
    SELECT round(avg(0.5*z*z + ln(10) + 0.9189385332046727), 6) AS nll, round(avg(10*(z*e + 2*exp(-0.5*z*z)/sqrt(2*pi()) - 1/sqrt(pi()))), 6) AS crps, round(avg(CASE WHEN abs(y-yhat) <= 1.6448536269514722*10 THEN 1.0 ELSE 0.0 END), 6) AS picp,
    round(sqrt(avg((y-yhat)*(y-yhat))), 6) AS rmse, round(avg(abs(y-yhat)), 6) AS mae FROM e""")  # fmt: skip
def gaussian(spark, sf_dir):
    return _rounded(metrics.gaussian(predictions(spark, sf_dir).withColumn("s", F.lit(10.0)), "y", "yhat", "s"))


@query("a19_route_distribution", f"WITH {PREDICTIONS} SELECT guess, count(*) AS branch_count, round(count(*) / sum(count(*)) OVER (), 6) AS ratio FROM pred GROUP BY 1")
def route_distribution(spark, sf_dir):
    return metrics.route_distribution(predictions(spark, sf_dir), "guess").select("guess", "branch_count", r("ratio"))


@query("a20_fold_summary", f"""WITH {PREDICTIONS}, f AS (SELECT l_orderkey % 5 AS fold, avg(abs(y-yhat)) AS mae, avg(y) AS level FROM pred GROUP BY 1)
    SELECT 'mae' AS metric, round(avg(mae), 6) AS mean, round(stddev_pop(mae), 6) AS std FROM f UNION ALL SELECT 'level', round(avg(level), 6), round(stddev_pop(level), 6) FROM f""")  # fmt: skip
def fold_summary(spark, sf_dir):
    folds = predictions(spark, sf_dir).groupBy((F.col("l_orderkey") % 5).alias("fold")).agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"), F.avg("y").alias("level"))
    return metrics.fold_summary(folds, ["fold", "mae", "level"], ("fold",)).select("metric", r("mean"), r("std"))


_W = "OVER (PARTITION BY series ORDER BY d)"


@query("w1_lagged", f"""WITH {FLAG_DAYS}, s AS (SELECT series, d, y AS lag_1, lag(y) {_W} AS lag_2, lag(y, 2) {_W} AS lag_3, lead(y) {_W} AS target, row_number() {_W} AS a, count(*) OVER (PARTITION BY series) AS n FROM days)
    SELECT series, d, round(lag_1, 6) AS lag_1, round(lag_3, 6) AS lag_3, round(target, 6) AS target, CASE WHEN n - a + 1 <= 31 THEN 'valid' ELSE 'train' END AS split FROM s WHERE a >= 3 AND a < n""")  # fmt: skip
def lagged(spark, sf_dir):
    return timeseries.lagged(flag_days(spark, sf_dir), "y", "d", ["series"], [1, 3], 1, 30).select("series", "d", r("lag_1"), r("lag_3"), r("target"), "split")


@query("w2_sequence_targets", f"""WITH {FLAG_DAYS}, s AS (SELECT series, d, y, lead(y) {_W} AS t1, lead(y, 2) {_W} AS t2, row_number() {_W} AS a, count(*) OVER (PARTITION BY series) AS n FROM days)
    SELECT series, d, round(y, 6) AS lag_1, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM s WHERE a <= n - 2""")  # fmt: skip
def sequence_targets(spark, sf_dir):
    out = timeseries.lagged(flag_days(spark, sf_dir), "y", "d", ["series"], [1], 2)
    return out.select("series", "d", r("lag_1"), r(F.col("target")[0], name="t1"), r(F.col("target")[1], name="t2"))


_MA = f"""m AS (SELECT series, d, y, row_number() {_W} AS rn, count(*) OVER (PARTITION BY series) AS n, sum(y) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s,
    first_value(y) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(y) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM days),
    t AS (SELECT series, d, y, rn, (s + greatest(0, 4 - rn) * f + greatest(0, rn + 3 - n) * l) / 7 AS trend FROM m)"""


@query("w9_moving_average", f"WITH {FLAG_DAYS}, {_MA} SELECT series, d, round(trend, 6) AS trend FROM t")
def moving_average(spark, sf_dir):
    return flag_days(spark, sf_dir).select("series", "d", r(timeseries.centered_average("y", "d", ["series"], 7), name="trend"))


@query("w7_decompose", f"""WITH {FLAG_DAYS}, {_MA}, p AS (SELECT series, (rn - 1) % 7 AS ph, avg(y - trend) AS pm FROM t GROUP BY 1, 2), c AS (SELECT series, avg(pm) AS mm FROM p GROUP BY 1)
    SELECT t.series, d, round(trend, 6) AS trend, round(pm - mm, 6) AS seasonal, round(y - trend - (pm - mm), 6) AS resid FROM t JOIN p ON p.series = t.series AND ph = (rn - 1) % 7 JOIN c ON c.series = t.series""")  # fmt: skip
def decompose(spark, sf_dir):
    return timeseries.decompose(flag_days(spark, sf_dir), "y", "d", ["series"], 7).select("series", "d", r("trend"), r("seasonal"), r("resid"))


@query("w24_difference", f"WITH {FLAG_DAYS}, a AS (SELECT series, d, y - lag(y, 7) {_W} AS y FROM days), b AS (SELECT * FROM a WHERE y IS NOT NULL), c AS (SELECT series, d, y - lag(y) {_W} AS y FROM b) SELECT series, d, round(y, 6) AS y FROM c WHERE y IS NOT NULL")
def difference(spark, sf_dir):
    return timeseries.difference(flag_days(spark, sf_dir), "y", "d", ["series"], 1, 1, 7).select("series", "d", r("y"))


def _origin(expr: str) -> str:
    return f"""WITH {FLAG_DAYS}, s AS (SELECT series, d, y, row_number() {_W} AS a, count(*) OVER (PARTITION BY series) AS n, lead(y) {_W} AS y1, lead(y, 2) {_W} AS y2,
        lag(y) {_W} AS l1, lag(y, 2) {_W} AS l2, lag(y, 5) {_W} AS l5, lag(y, 6) {_W} AS l6 FROM days), k AS (SELECT * FROM s WHERE a >= 30 AND n - a >= 2)
        {expr}"""


@query("w14_naive", _origin("SELECT series, d, 1 AS step, round(y1, 6) AS y, round(y, 6) AS yhat FROM k UNION ALL SELECT series, d, 2, round(y2, 6), round(y, 6) FROM k"))
def naive(spark, sf_dir):
    return timeseries.rolling_origin(flag_days(spark, sf_dir), "y", "d", ["series"], "naive", 30, 2).select("series", "d", "step", r("y"), r("yhat"))


@query("w17_seasonal_naive", _origin("SELECT series, d, 1 AS step, round(y1, 6) AS y, round(l6, 6) AS yhat FROM k UNION ALL SELECT series, d, 2, round(y2, 6), round(l5, 6) FROM k"))
def seasonal_naive(spark, sf_dir):
    return timeseries.rolling_origin(flag_days(spark, sf_dir), "y", "d", ["series"], "seasonal_naive", 30, 2, period=7).select("series", "d", "step", r("y"), r("yhat"))


@query("w17_moving_average", _origin("SELECT series, d, 1 AS step, round(y1, 6) AS y, round((l2+l1+y)/3, 6) AS yhat FROM k UNION ALL SELECT series, d, 2, round(y2, 6), round((l1+y+(l2+l1+y)/3)/3, 6) FROM k"))
def average_forecast(spark, sf_dir):
    return timeseries.rolling_origin(flag_days(spark, sf_dir), "y", "d", ["series"], "moving_average", 30, 2, window=3).select("series", "d", "step", r("y"), r("yhat"))


@query("a53_linear_fit", "SELECT l_returnflag, round(regr_intercept(l_extendedprice / 1000, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice / 1000, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def linear_fit(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").withColumn("t", F.col("l_extendedprice") / 1000)
    out = timeseries.fit_linear(x, ["l_quantity"], "t", ["l_returnflag"])
    return out.select("l_returnflag", r(F.col("coefficients")[0], 4, "intercept"), r(F.col("coefficients")[1], 4, "slope"))


@query("w18_autoregressive", f"""WITH {FLAG_DAYS}, s AS (SELECT series, d, y, lead(y) {_W} AS t FROM days), f AS (SELECT series, regr_intercept(t, y) AS a, regr_slope(t, y) AS b FROM s GROUP BY 1),
    e AS (SELECT series, arg_max(y, d) AS y FROM days GROUP BY 1) SELECT series, 1 AS step, round(a + b*y, 5) AS yhat FROM e JOIN f USING (series) UNION ALL SELECT series, 2, round(a + b*(a + b*y), 5) FROM e JOIN f USING (series)""")  # fmt: skip
def autoregressive(spark, sf_dir):
    return timeseries.autoregressive(flag_days(spark, sf_dir), "y", "d", ["series"], [1], 2).select("series", "step", r("yhat", 5))


def _wide(spark, sf_dir):
    flags = ["A", "N", "R"]
    return flag_days(spark, sf_dir).groupBy("d").pivot("series", flags).agg(F.first("y"))


def _flag_tests(spark, sf_dir):
    """Each two series on the days that both have, either way, at every lag up to 3."""
    wide, out = _wide(spark, sf_dir), None
    for x, y in ("AR", "AN", "NR"):
        part = timeseries.granger(wide, [(x, y), (y, x)], "d", 3)
        out = part if out is None else out.unionByName(part)
    return out


@query("w32_granger", None)
def granger(spark, sf_dir):
    """Every ordered pair of the three series that run side by side."""
    return _flag_tests(spark, sf_dir).select("cause", "effect", "lag", r("f_statistic", 4), r("p_value", 6))


@query("w32_granger_best", None)
def granger_best(spark, sf_dir):
    return timeseries.best_lags(_flag_tests(spark, sf_dir), ["cause", "effect"]).select("cause", "effect", "lag", r("f_statistic", 4), r("p_value", 6), "significant")


_AHEAD = f"""{FLAG_DAYS}, c0 AS (SELECT series, d, y, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS b FROM days)"""


@query("w16_holdout", f"""WITH {_AHEAD}, h AS (SELECT series, d, y FROM c0 WHERE b > 14), l AS (SELECT series, arg_max(y, d) AS yhat FROM h GROUP BY 1), s AS (SELECT series, avg(abs(y - p)) AS scale FROM (SELECT series, y, lag(y, 7) {"OVER (PARTITION BY series ORDER BY d)"} AS p FROM h) GROUP BY 1)
    SELECT series, round(sqrt(avg((yhat-y)*(yhat-y))), 5) AS rmse, round(avg(yhat-y), 5) AS bias, round(avg(abs(yhat-y)) / max(scale), 5) AS mase FROM c0 JOIN l USING (series) JOIN s USING (series) WHERE b <= 14 GROUP BY 1""")  # fmt: skip
def holdout(spark, sf_dir):
    """The last value before the tail, repeated over it."""
    def last(history, horizon):
        end = history.groupBy("series").agg(F.max_by("y", "d").alias("yhat"))
        return end.select("series", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "yhat")

    out = timeseries.holdout(flag_days(spark, sf_dir), "y", "d", ["series"], 14, last, 7)
    return out.select("series", r("rmse", 5), r("bias", 5), r("mase", 5))


_DIFFS = f"""{FLAG_DAYS}, z0 AS (SELECT series, d, y, y - lag(y) OVER (PARTITION BY series ORDER BY d) AS z FROM days), z AS (SELECT series, d, y, z, lag(z) OVER (PARTITION BY series ORDER BY d) AS l FROM z0 WHERE z IS NOT NULL),
    f AS (SELECT series, regr_intercept(z, l) AS a, regr_slope(z, l) AS b FROM z WHERE l IS NOT NULL GROUP BY 1), e AS (SELECT series, arg_max(y, d) AS y, arg_max(z, d) AS z FROM z GROUP BY 1),
    p AS (SELECT series, y, a + b*z AS z1, a + b*(a + b*z) AS z2 FROM e JOIN f USING (series))"""


@query("w21_arima", f"WITH {_DIFFS} SELECT series, 1 AS step, round(y + z1, 4) AS yhat FROM p UNION ALL SELECT series, 2, round(y + z1 + z2, 4) FROM p")
def arima(spark, sf_dir):
    out = timeseries.arima(flag_days(spark, sf_dir), "y", "d", ["series"], 2, (1, 1, 0))
    return out.select("series", "step", r("yhat", 4))


@query("w20_lag_estimator", f"""WITH {FLAG_DAYS}, s AS (SELECT series, d, y, lead(y) OVER (PARTITION BY series ORDER BY d) AS t FROM days), f AS (SELECT regr_intercept(t, y) AS a, regr_slope(t, y) AS b FROM s),
    e AS (SELECT series, arg_max(y, d) AS y FROM days GROUP BY 1) SELECT series, 1 AS step, round(a + b*y, 4) AS yhat FROM e, f UNION ALL SELECT series, 2, round(a + b*(a + b*y), 4) FROM e, f""")  # fmt: skip
def lag_estimator(spark, sf_dir):
    """One linear regression over all series."""
    from pyspark.ml.regression import LinearRegression

    model = timeseries.LagEstimator(LinearRegression(regParam=0.0, solver="normal"), "y", "d", ["series"], [1])
    days = flag_days(spark, sf_dir)
    return model.fit(days).forecast(days, 2).select("series", "step", r("yhat", 4))


_P = "OVER (PARTITION BY brand ORDER BY d)"
_FEATURES = f"""{BRAND_DAYS}, mk AS (SELECT d, avg(ret) AS market_ret FROM panel GROUP BY 1), f0 AS (SELECT d, brand, ret AS ret_1, lead(ret) {_P} AS target,
    avg(ret) OVER (PARTITION BY brand ORDER BY d ROWS 4 PRECEDING) AS mom_short, avg(ret) OVER (PARTITION BY brand ORDER BY d ROWS 19 PRECEDING) AS mom_long,
    stddev_samp(ret) OVER (PARTITION BY brand ORDER BY d ROWS 19 PRECEDING) AS vol_long, row_number() {_P} AS rn FROM panel),
    f AS (SELECT f0.*, market_ret, ret_1 - market_ret AS rel_mom FROM f0 JOIN mk USING (d) WHERE rn >= 20 AND target IS NOT NULL)"""


def _features(spark, sf_dir):
    return panel.features(brand_days(spark, sf_dir), "d", "brand", "ret")


# Means of values of seven decimals have nine at most, so nothing is a tie after this shift.
_OFF = 3e-11
_MEASURES = ("target", "ret_1", "mom_short", "mom_long", "vol_long", "market_ret", "rel_mom")


@query("w10_panel_features", f"WITH {_FEATURES} SELECT d, brand, {', '.join(f'round({c} + {_OFF}, 5) AS {c}' for c in _MEASURES)} FROM f")
def panel_features(spark, sf_dir):
    return _features(spark, sf_dir).select("d", "brand", *(r(F.col(c) + _OFF, 5, c) for c in _MEASURES))


_FULL = f"""{BRAND_DAYS}, m0 AS (SELECT d, avg(ret) AS market_ret_1 FROM panel GROUP BY 1), mk AS (SELECT d, market_ret_1, avg(market_ret_1) OVER (ORDER BY d ROWS 4 PRECEDING) AS m5, avg(market_ret_1) OVER (ORDER BY d ROWS 19 PRECEDING) AS m20, row_number() OVER (ORDER BY d) AS rd FROM m0),
    f0 AS (SELECT d, brand, lead(ret) {_P} AS target, ret AS ret_lag_1, lag(ret) {_P} AS ret_lag_2, avg(ret) OVER (PARTITION BY brand ORDER BY d ROWS 4 PRECEDING) AS mom_5, avg(ret) OVER (PARTITION BY brand ORDER BY d ROWS 19 PRECEDING) AS mom_20,
    stddev_samp(ret) OVER (PARTITION BY brand ORDER BY d ROWS 19 PRECEDING) AS vol_20, row_number() {_P} AS rn FROM panel),
    f AS (SELECT d, brand, target, ret_lag_1, ret_lag_2, mom_5, mom_20, vol_20, market_ret_1, m5 AS market_mom_5, mom_20 - m20 AS relative_mom_20 FROM f0 JOIN mk USING (d) WHERE rn >= 20 AND rd >= 20 AND target IS NOT NULL)"""
_FULL_MEASURES = ("target", "ret_lag_1", "ret_lag_2", "mom_5", "mom_20", "vol_20", "market_ret_1", "market_mom_5", "relative_mom_20")


@query("w11_panel_features_full", f"WITH {_FULL} SELECT d, brand, {', '.join(f'round({c} + {_OFF}, 5) AS {c}' for c in _FULL_MEASURES)}, CAST(dense_rank() OVER (ORDER BY brand) - 1 AS DOUBLE) AS ticker_code FROM f")
def panel_features_full(spark, sf_dir):
    f = panel.features_full(brand_days(spark, sf_dir), "d", "brand", "ret")
    return f.select("d", "brand", *(r(F.col(c) + _OFF, 5, c) for c in _FULL_MEASURES), "ticker_code")


_RUN = "runs AS (SELECT l_suppkey AS fold, avg(l_tax) AS test_rmse, avg(l_discount) AS direction_accuracy, CASE WHEN l_suppkey % 4 <> 0 THEN avg(l_quantity)/100 END AS rank_ic, avg(l_linenumber) AS turnover FROM lineitem GROUP BY 1)"


@query("a41_run_summary", f"""WITH {_RUN} SELECT round(avg(test_rmse), 6) AS test_rmse_mean, round(avg(direction_accuracy), 6) AS direction_accuracy_mean, round(avg(coalesce(rank_ic, 0)), 6) AS rank_ic_mean, 0.0 AS hit_rate_mean, 0.0 AS net_sharpe_mean, 0.0 AS max_drawdown_abs_mean,
    round(avg(turnover), 6) AS turnover_mean, round(stddev_pop(coalesce(rank_ic, 0)), 6) AS rank_ic_std, count(*) AS folds FROM runs""")  # fmt: skip
def run_summary(spark, sf_dir):
    """Folds that lack three of the seven metrics, and some of them a fourth."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("fold")).agg(
        F.avg("l_tax").alias("test_rmse"), F.avg("l_discount").alias("direction_accuracy"), (F.avg("l_quantity") / 100).alias("rank_ic"), F.avg("l_linenumber").alias("turnover")
    )
    rows = rows.withColumn("rank_ic", F.when(F.col("fold") % 4 != 0, F.col("rank_ic")))
    rows = rows.withColumns({n: F.lit(None).cast("double") for n in ("hit_rate", "net_sharpe", "max_drawdown_abs")})
    return _rounded(panel.run_summary(rows), "folds")


_RANKS = "(rank() OVER (PARTITION BY d ORDER BY {0}) + (count(*) OVER (PARTITION BY d, {0}) - 1) / 2)"
_IC = f"""k AS (SELECT d, {_RANKS.format('mom_short')} AS rp, {_RANKS.format('target')} AS rt FROM f),
    ic AS (SELECT d, count(*) AS n, CASE WHEN stddev_pop(rp) > 1e-12 AND stddev_pop(rt) > 1e-12 THEN covar_pop(rp, rt) / (stddev_pop(rp) * stddev_pop(rt)) ELSE 0 END AS ic FROM k GROUP BY 1 HAVING count(*) >= 3)"""


@query("a43_rank_ic", f"WITH {_FEATURES}, {_IC} SELECT d, n, round(ic, 5) AS ic FROM ic")
def rank_ic(spark, sf_dir):
    return panel.daily_rank_ic(_features(spark, sf_dir), "d", "mom_short", "target").select("d", "n", r("ic", 5))


@query("panel_rank_ic", f"WITH {_FEATURES}, {_IC} SELECT count(*) AS n_dates, round(avg(ic), 6) AS mean_ic FROM ic")
def panel_rank_ic(spark, sf_dir):
    """The flagship: scan, join, aggregate, windows, ranks, correlation by date."""
    daily = panel.daily_rank_ic(_features(spark, sf_dir), "d", "mom_short", "target")
    return daily.agg(F.count("*").alias("n_dates"), r(F.avg("ic"), name="mean_ic"))


@query("w27_average_rank", f"WITH {_FEATURES} SELECT d, brand, {_RANKS.format('rel_mom')} AS rk FROM f")
def ranks(spark, sf_dir):
    return _features(spark, sf_dir).select("d", "brand", average_rank(F.col("rel_mom"), "d").alias("rk"))


_DATES = "dt AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM panel))"


@query("w12_walk_forward", f"""WITH {BRAND_DAYS}, {_DATES}, fd AS (SELECT 0 AS fold UNION ALL SELECT 1 UNION ALL SELECT 2)
    SELECT fold, CASE WHEN pos < 300 + fold*100 THEN 'train' ELSE 'test' END AS split, d FROM fd, dt WHERE pos >= greatest(0, 300 + fold*100 - 250) AND pos < least(300 + fold*100 + 80, n) AND 300 + fold*100 + 80 <= n""")  # fmt: skip
def walk_forward(spark, sf_dir):
    return panel.walk_forward_folds(brand_days(spark, sf_dir), "d", 300, 80, 100, "rolling", 250, 3)


_PICKS = f"""{_FEATURES}, pk AS (SELECT d, brand, target / 1000 AS tr, row_number() OVER (PARTITION BY d ORDER BY mom_short DESC, brand) AS rk FROM f),
    dy AS (SELECT d, avg(tr) AS gross, list(brand ORDER BY brand) AS held FROM pk WHERE rk <= 3 GROUP BY 1), pv AS (SELECT *, lag(held) OVER (ORDER BY d) AS prev FROM dy),
    tn AS (SELECT d, gross, CASE WHEN prev IS NULL THEN 1.0 ELSE 1 - len(list_intersect(held, prev)) / len(list_distinct(list_concat(held, prev))) END AS turnover FROM pv),
    nt AS (SELECT *, gross - 0.0005 * turnover AS net FROM tn), eq AS (SELECT *, sum(ln(1 + net)) OVER (ORDER BY d) AS le FROM nt), dd AS (SELECT *, exp(le - max(le) OVER (ORDER BY d)) - 1 AS drawdown FROM eq)"""


def _portfolio(spark, sf_dir):
    return panel.portfolio(_features(spark, sf_dir).withColumn("tr", F.col("target") / 1000), "d", "brand", "mom_short", "tr", 3)


@query("t7_top_assets", f"WITH {_PICKS} SELECT d, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(net, 6) AS net FROM dd")
def top_assets(spark, sf_dir):
    return _portfolio(spark, sf_dir).select("d", r("gross"), r("turnover"), r("net"))


@query("a42_portfolio", f"WITH {_PICKS} SELECT round(avg(net) / stddev_pop(net) * sqrt(252), 4) AS sharpe, round(min(drawdown), 5) AS max_drawdown, round(avg(turnover), 6) AS turnover, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM dd")
def portfolio(spark, sf_dir):
    return panel.portfolio_summary(_portfolio(spark, sf_dir)).select(r("sharpe", 4), r("max_drawdown", 5), r("turnover"), r("hit_rate"))


@query("a44_direction", f"WITH {_FEATURES} SELECT round(avg(CASE WHEN sign(rel_mom) = sign(target - market_ret) THEN 1.0 ELSE 0.0 END), 6) AS direction_accuracy FROM f")
def direction(spark, sf_dir):
    rows = _features(spark, sf_dir).withColumn("t", F.col("target") - F.col("market_ret"))
    return _rounded(panel.direction_accuracy(rows, "rel_mom", "t"))


@query("a45_error_blend", f"WITH {PREDICTIONS}, e AS (SELECT 1/sqrt(avg((y-yhat)*(y-yhat))) AS a, 1/sqrt(avg((y-low)*(y-low))) AS b FROM pred) SELECT l_returnflag, round(avg((a*yhat + b*low)/(a+b)), 6) AS prediction FROM pred, e GROUP BY 1")
def error_blend(spark, sf_dir):
    p = predictions(spark, sf_dir)
    errors = {c: metrics.regression(p, "y", c).first()["rmse"] for c in ("yhat", "low")}
    return prep.blend(p, prep.inverse_error_weights(errors)).groupBy("l_returnflag").agg(r(F.avg("prediction"), name="prediction"))


@query("j4_fold_panel", f"WITH {BRAND_DAYS}, {_DATES} SELECT brand, count(*) AS n, round(sum(ret), 4) AS total FROM panel WHERE d IN (SELECT d FROM dt WHERE pos < 100) GROUP BY 1")
def fold_panel(spark, sf_dir):
    rows = brand_days(spark, sf_dir)
    dates = panel.walk_forward_folds(rows, "d", 100, 50, 50, max_folds=1).where("split = 'train'").select("d")
    return rows.join(dates, "d", "left_semi").groupBy("brand").agg(F.count("*").alias("n"), r(F.sum("ret"), 4, "total"))


@query("p13_tail", f"WITH {FLAG_DAYS}, s AS (SELECT series, d, y, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS b FROM days) SELECT series, d, round(y, 6) AS y FROM s WHERE b <= 14")
def tail(spark, sf_dir):
    return timeseries.tail(flag_days(spark, sf_dir), "d", ["series"], 14).select("series", "d", r("y"))


@query("u1_wide_to_long", f"""WITH {BRAND_DAYS}, fine AS (SELECT substr(d, 1, 4) AS d, brand, sum(ret) AS ret FROM panel GROUP BY 1, 2 HAVING isfinite(sum(ret))), whole AS (SELECT d FROM fine GROUP BY 1 HAVING count(*) = 25)
    SELECT brand AS ticker, count(*) AS n, round(sum(ret), 4) AS total FROM fine WHERE d IN (SELECT d FROM whole) GROUP BY 1""")  # fmt: skip
def wide_to_long(spark, sf_dir):
    years = brand_days(spark, sf_dir).groupBy(F.substring("d", 1, 4).alias("d"))
    wide = years.pivot("brand", [f"Brand#{i}" for i in range(1, 26)]).agg(F.sum("ret"))
    return panel.wide_to_long(wide, "d", wide.columns[1:]).groupBy("ticker").agg(F.count("*").alias("n"), r(F.sum("ret"), 4, "total"))
