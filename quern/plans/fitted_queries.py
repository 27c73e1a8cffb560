"""Queries of fitted models over series, panels and rows: moving averages, sparse networks, splines, decompositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import arma, arma_likelihood, decomposition, sparse_var, splines
from quern.plans.tables import FLAG_DAYS, brand_days, flag_days, r, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_W = "OVER (PARTITION BY series ORDER BY d)"
_TWO_STAGE = f"""{FLAG_DAYS}, z0 AS (SELECT series, d, y, y - lag(y) {_W} AS z FROM days), z1 AS (SELECT *, lag(z) {_W} AS l FROM z0 WHERE z IS NOT NULL),
    f1 AS (SELECT series, regr_intercept(z, l) AS a, regr_slope(z, l) AS b FROM z1 WHERE l IS NOT NULL GROUP BY 1),
    e1 AS (SELECT series, d, y, z, z - a - b * l AS e FROM z1 JOIN f1 USING (series) WHERE l IS NOT NULL), e2 AS (SELECT *, lag(e) {_W} AS le FROM e1),
    f2 AS (SELECT series, regr_intercept(z, le) AS c, regr_slope(z, le) AS t FROM e2 WHERE le IS NOT NULL GROUP BY 1),
    p AS (SELECT series, arg_max(y, d) AS y, arg_max(e, d) AS e FROM e1 GROUP BY 1)"""


@query("w21_arima_two_stage", f"""WITH {_TWO_STAGE} SELECT series, step, round(y + c + t * e + (step - 1) * c, 4) AS yhat, '(0,1,1)' AS fitted, '' AS ignored FROM p JOIN f2 USING (series), range(1, 4) s(step)""")
def arima_two_stage(spark, sf_dir):
    """A moving average of first differences, three steps ahead."""
    out = arma.forecast(flag_days(spark, sf_dir), "y", "d", ["series"], 3, (0, 1, 1), long_order=1)
    return out.select("series", F.col("step").cast("long").alias("step"), r("yhat", 4), "fitted", "ignored")


@query("a54_moving_average_fit", f"""WITH {_TWO_STAGE} SELECT series, round(c, 5) AS intercept, round(t, 5) AS ma_1, n FROM f2 JOIN (SELECT series, count(le) AS n FROM e2 GROUP BY 1) USING (series)""")
def moving_average_fit(spark, sf_dir):
    fitted, _ = arma.fit(flag_days(spark, sf_dir), "y", "d", ["series"], (0, 1, 1), long_order=1)
    return fitted.select("series", r("intercept", 5), r(F.col("ma")[0], 5, "ma_1"), "n")


@query("w21_arima_likelihood", None)
def arima_likelihood(spark, sf_dir):
    """First differences with one lag and one moving average, at the greatest conditional likelihood, series by series."""
    out = arma_likelihood.fit(flag_days(spark, sf_dir), "y", "d", ["series"], (1, 1, 1))
    return out.select("series", r("intercept", 4), r(F.col("ar")[0], 4, "ar_1"), r(F.col("ma")[0], 4, "ma_1"), "n", r("loglik", 2), r("aic", 2), r("bic", 2), "converged")


def _brand_table(spark, sf_dir):
    return brand_days(spark, sf_dir).groupBy("d").pivot("brand").agg(F.first("ret")).fillna(0.0)


@query("w33_sparse_var", None)
def sparse_network(spark, sf_dir):
    """Which brand's revenue helps to tell which one's next day, of all pairs of brands."""
    wide = _brand_table(spark, sf_dir)
    out = sparse_var.network(wide, sorted(c for c in wide.columns if c != "d"), "d", l1=0.0005)
    return out.select("effect", "cause", r("coefficient", 5), r("mse"), r("r2"))


_BASIS = " + ".join(f"({(-1) ** i * c}) * pow(greatest(u - {i}, 0), 3)" for i, c in enumerate((1, 4, 6, 4)))


@query("e7_basis", f"""WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), x AS (SELECT l_orderkey, l_linenumber, (l_quantity - lo) / ((hi - lo) / 5) + 3 AS v FROM lineitem, s),
    b AS (SELECT l_orderkey, l_linenumber, j, v - j AS u FROM x, range(7) q(j)) SELECT l_orderkey, l_linenumber, j AS place, round(CASE WHEN u > 0 AND u < 4 THEN ({_BASIS}) / 6 ELSE 0 END, 6) AS value FROM b""")
def spline_basis(spark, sf_dir):
    """Cubic basis functions of the quantity, on six knots."""
    items = read(spark, sf_dir, "lineitem")
    ends = items.agg(F.min("l_quantity"), F.max("l_quantity")).first()
    s = splines.Spline("l_quantity", ends[0], ends[1], 6)
    return items.select("l_orderkey", "l_linenumber", F.posexplode(F.array(*s.columns(F.col("l_quantity")))).alias("place", "value")).select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"), r("value"))


@query("e7_linearity", None)
def linearity(spark, sf_dir):
    """Whether price depends on quantity, discount, tax and line number by lines or curves; five folds by order."""
    items = read(spark, sf_dir, "lineitem")
    out = splines.linearity(items, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], F.col("l_extendedprice") / 1000, F.col("l_orderkey") % 5)
    return out.select("feature", "kind", "nonlinear", "alpha", *(r(c, 4) for c in ("slope", "curve_span", "line_span", "linear_rmse", "spline_rmse")))


_SPLIT = "2000-01-01"
_OLD = f"""days0 AS (SELECT series, d, y FROM days WHERE d < '{_SPLIT}'), m AS (SELECT series, d, y, row_number() {_W} AS rn, count(*) OVER (PARTITION BY series) AS n, sum(y) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s,
    first_value(y) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(y) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM days0),
    t AS (SELECT series, d, y, rn, n, (s + greatest(0, 4 - rn) * f + greatest(0, rn + 3 - n) * l) / 7 AS trend FROM m),
    p AS (SELECT series, (rn - 1) % 7 AS ph, avg(y - trend) AS pm FROM t WHERE n >= 14 GROUP BY 1, 2), c AS (SELECT series, avg(pm) AS mm FROM p GROUP BY 1),
    e AS (SELECT series, max(n) AS n, arg_max(trend, rn) AS te, (arg_max(trend, rn) - arg_min(trend, rn)) / (max(n) - 1) AS slope FROM t WHERE n >= 14 GROUP BY 1),
    later AS (SELECT series, d, y, row_number() {_W} AS k FROM days WHERE d >= '{_SPLIT}'), j AS (SELECT later.*, te + slope * k AS trend, (n + k - 1) % 7 AS ph FROM later LEFT JOIN e USING (series))"""


@query("w8_fitted_decomposition", f"""WITH {FLAG_DAYS}, {_OLD} SELECT j.series, d, round(trend, 6) AS trend, round(pm - mm, 6) AS seasonal, round(y - trend - (pm - mm), 6) AS resid FROM j LEFT JOIN p ON p.series = j.series AND p.ph = j.ph LEFT JOIN c ON c.series = j.series""")
def fitted_decomposition(spark, sf_dir):
    """Parts of the days from 2000 on, by phases and trend of the days before."""
    days = flag_days(spark, sf_dir)
    fitted = decomposition.SeasonalDecomposition("y", "d", ["series"], 7).fit(days.where(F.col("d") < _SPLIT))
    return fitted.transform(days.where(F.col("d") >= _SPLIT)).select("series", "d", r("trend"), r("seasonal"), r("resid"))


@query("w5_windowing_of_residuals", f"""WITH {FLAG_DAYS}, {_OLD}, w AS (SELECT j.series, d, y - trend - (pm - mm) AS v FROM j JOIN p ON p.series = j.series AND p.ph = j.ph JOIN c ON c.series = j.series)
    SELECT * FROM (SELECT series, d, round(v, 6) AS lag_1, round(lag(v) {_W}, 6) AS lag_2, round(lead(v) {_W}, 6) AS target FROM w) WHERE lag_2 IS NOT NULL AND target IS NOT NULL""")
def windowing_of_residuals(spark, sf_dir):
    """Supervised rows of the residuals that the fitted decomposition leaves of later days."""
    from quern.operators import timeseries

    days = flag_days(spark, sf_dir)
    fitted = decomposition.SeasonalDecomposition("y", "d", ["series"], 7).fit(days.where(F.col("d") < _SPLIT))
    rest = fitted.transform(days.where(F.col("d") >= _SPLIT)).where("resid is not null")
    return timeseries.lagged(rest, "resid", "d", ["series"], [1, 2]).select("series", "d", r("lag_1"), r("lag_2"), r("target"))


_EXOG = "known AS (SELECT l_returnflag AS series, strftime(l_shipdate, '%Y-%m-%d') AS d, avg(l_quantity) AS y, count(*) AS items FROM lineitem GROUP BY 1, 2)"


@query("j14_history_alignment", f"""WITH {_EXOG}, h AS (SELECT series, d, CASE WHEN series = 'N' THEN y + 1 ELSE y END AS y, row_number() {_W} AS k FROM known WHERE d < '{_SPLIT}'),
    q AS (SELECT series, y AS ky, items, row_number() {_W} AS k FROM known), b AS (SELECT h.*, ky, items FROM h LEFT JOIN q ON q.series = h.series AND q.k = h.k),
    v AS (SELECT series, bool_and(coalesce(abs(y - ky) <= 1e-12, false)) AS same, count(*) AS n FROM b GROUP BY 1), z AS (SELECT series, count(*) AS n FROM known GROUP BY 1),
    m AS (SELECT v.series, CASE WHEN same THEN 'prefix' WHEN v.n = z.n THEN 'length' ELSE 'none' END AS match FROM v JOIN z ON z.series = v.series)
    SELECT b.series, d, CASE WHEN match <> 'none' THEN items END AS items, match FROM b JOIN m ON m.series = b.series""")  # fmt: skip
def history_alignment(spark, sf_dir):
    """Numbers of items beside the days before 2000; one series has other values than the known one."""
    items = read(spark, sf_dir, "lineitem")
    known = items.groupBy(F.col("l_returnflag").alias("series"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("d")).agg(F.avg("l_quantity").alias("y"), F.count("*").alias("items"))
    history = known.where(F.col("d") < _SPLIT).select("series", "d", F.when(F.col("series") == "N", F.col("y") + 1).otherwise(F.col("y")).alias("y"))
    return decomposition.align_history(history, known, "y", "d", ["series"], ["items"]).select("series", "d", "items", "match")
