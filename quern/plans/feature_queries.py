"""Queries over features: primitives, expressions, preparation, pools."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import conditional as C
from quern.functions import distributions as D
from quern.functions import expressions as X
from quern.functions import guards as G
from quern.functions import primitives as P
from quern.operators import guards, moments, pool, prep
from quern.operators.quantiles import quantiles
from quern.plans.tables import r, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_X = "x AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_orderkey AS k, l_linenumber AS n, l_quantity / 10 AS a, l_discount * 20 - 1 AS b, l_tax * 50 AS c, l_extendedprice / 10000 AS t FROM lineitem)"


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 20 - 1).alias("b"), (F.col("l_tax") * 50).alias("c"), (F.col("l_extendedprice") / 10000).alias("t"),
    )


# The oracles' own wording of each primitive.
_SQL_UNARY = {
    "identity": "z", "square": "z*z", "cube": "z*z*z", "pow4": "pow(z,4)", "pow5": "pow(z,5)", "pow6": "pow(z,6)", "sin": "sin(z)", "cos": "cos(z)",
    "tanh": "tanh(z)", "softsign": "z/(abs(z)+8)", "inverse_quadratic": "64/(z*z+64)", "log1p_abs": "ln(1+abs(z))", "log1p_square": "ln(1+z*z)",
    "sqrt1p_abs": "sqrt(abs(z)+1)", "exp_clip": "exp(greatest(least(z/8,30),-30))", "softplus_clip": "ln(1+exp(greatest(least(z/8,30),-30)))",
    "reciprocal_safe": "1/(abs(z)+0.001)", "gaussian_rbf": "exp(greatest(-(z/8)*(z/8),-30))", "laplace_rbf": "exp(greatest(-abs(z)/8,-30))",
}
_SQL_PAIR = {
    "mul": "a*b", "add": "a+b", "safe_ratio": "a/(abs(b)+0.001)", "safe_ratio_reverse": "b/(abs(a)+0.001)", "square_left_mul": "a*a*b",
    "square_right_mul": "a*b*b", "mul_over_energy": "a*b/(a*a+b*b+64)", "tanh_right_mul": "a*tanh(b)", "softsign_right_mul": "a*b/(abs(b)+8)",
    "inverse_quad_right_mul": "a*64/(b*b+64)", "log_right_mul": "a*ln(1+abs(b))", "exp_right_mul": "a*exp(greatest(least(b/8,30),-30))",
    "gaussian_right_mul": "a*exp(greatest(-(b/8)*(b/8),-30))", "softsign_product": "a*b/(abs(a*b)+8)", "sin_product": "sin(a*b)",
    "log_abs_product": "ln(1+abs(a*b))", "sqrt_abs_product": "sqrt(abs(a*b)+1)", "tanh_tanh_product": "tanh(a)*tanh(b)",
}


def _unary(family: str):
    names = P.named(family)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _x(spark, sf_dir).groupBy("flag").agg(*(r(F.avg(P.unary(n, F.col("b") * 3)), name=n) for n in names))

    cols = ", ".join(f"round(avg({_SQL_UNARY[n].replace('z', '(b*3)')}), 6) AS {n}" for n in names)
    return query, f"WITH {_X} SELECT flag, {cols} FROM x GROUP BY flag"


def _pairs(family: str):
    names = P.named(family, pairs=True)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _x(spark, sf_dir).groupBy("flag").agg(*(r(F.avg(P.pair(n, F.col("a"), F.col("b"))), name=n) for n in names))

    cols = ", ".join(f"round(avg({_SQL_PAIR[n]}), 6) AS {n}" for n in names)
    return query, f"WITH {_X} SELECT flag, {cols} FROM x GROUP BY flag"


for _f in dict.fromkeys(p.family for p in P.UNARY.values()):
    QUERIES[f"m_unary_{_f}"], ORACLES[f"m_unary_{_f}"] = _unary(_f)
for _f in dict.fromkeys(p.family for p in P.PAIR.values()):
    QUERIES[f"m_pair_{_f}"], ORACLES[f"m_pair_{_f}"] = _pairs(_f)


def query(name: str, sql: str | None):
    """Register the function below under ``name``."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("m60_gates", f"""WITH {_X} SELECT status, round(avg(CASE WHEN a >= 2.5 THEN 1.0 ELSE 0.0 END), 6) AS binary_gate, round(avg(1/(1+exp(-(a-2.5)/0.5))), 6) AS soft_gate,
    round(avg(greatest(a-2, 0)), 6) AS right_hinge, round(avg(greatest(2-a, 0)), 6) AS left_hinge FROM x GROUP BY status""")  # fmt: skip
def gates(spark, sf_dir):
    a = F.col("a")
    return _x(spark, sf_dir).groupBy("status").agg(
        r(F.avg(P.binary_gate(a, 2.5)), name="binary_gate"), r(F.avg(P.soft_gate(a, 2.5, 0.5)), name="soft_gate"),
        r(F.avg(P.hinge(a, 2.0)), name="right_hinge"), r(F.avg(P.hinge(a, 2.0, right=False)), name="left_hinge"),
    )


@query("m67_quantile_gates", f"""WITH {_X}, q AS (SELECT quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.75) AS q3 FROM x)
    SELECT flag, round(avg(0.5*(1+tanh(8*(a-q1)))), 6) AS low_gate, round(avg(0.5*(1+tanh(8*(a-q3)))), 6) AS high_gate FROM x, q GROUP BY flag""")  # fmt: skip
def quantile_gates(spark, sf_dir):
    x = _x(spark, sf_dir)
    cuts = quantiles(x, F.col("a"), [0.25, 0.75]).select(F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    both = x.crossJoin(F.broadcast(cuts))  # one row of cuts
    return both.groupBy("flag").agg(r(F.avg(P.quantile_gate(F.col("a"), F.col("q1"))), name="low_gate"), r(F.avg(P.quantile_gate(F.col("a"), F.col("q3"))), name="high_gate"))


_EXPR = X.bi("div", X.bi("add", X.un("log", X.feature(0)), X.bi("mul", X.un("square", X.feature(1)), X.const(0.5))), X.un("sqrt", X.bi("sub", X.feature(2), X.feature(1))))
_SQL_EXPR = "(ln(abs(a)+1e-6)+b*b*0.5)/CASE WHEN abs(sqrt(abs(c-b)+1e-6)) < 1e-6 THEN 1e-6 ELSE sqrt(abs(c-b)+1e-6) END"


@query("m1_expression", f"WITH {_X} SELECT flag, status, round(avg({_SQL_EXPR}), 6) AS mean_value, round(max({_SQL_EXPR}), 6) AS max_value FROM x GROUP BY flag, status")
def expression(spark, sf_dir):
    value = X.to_column(_EXPR, [F.col("a"), F.col("b"), F.col("c")])
    return _x(spark, sf_dir).groupBy("flag", "status").agg(r(F.avg(value), name="mean_value"), r(F.max(value), name="max_value"))


@query("m7_derivative", f"WITH {_X} SELECT flag, round(avg(2*b*sin(a) + 1), 6) AS d_b, round(avg(b*b*cos(a)), 6) AS d_a FROM x GROUP BY flag")
def differentiate(spark, sf_dir):
    e = X.bi("add", X.bi("mul", X.un("square", X.feature(1)), X.un("sin", X.feature(0))), X.feature(1))
    cols = [F.col("a"), F.col("b")]
    value = lambda i: X.to_column(X.derivative(e, X.feature(i)), cols)
    return _x(spark, sf_dir).groupBy("flag").agg(r(F.avg(value(1)), name="d_b"), r(F.avg(value(0)), name="d_a"))


@query("a52_parameter_gradient", f"WITH {_X} SELECT round(2*avg(a*(1.5*a+0.5-t)), 6) AS w, round(2*avg(1.5*a+0.5-t), 6) AS bias FROM x")
def parameter_gradient(spark, sf_dir):
    param = lambda n: {"type": "param", "name": n, "init": 0.0}
    e = X.bi("add", X.bi("mul", param("w"), X.feature(0)), param("bias"))
    grads = X.gradient(e, F.col("t"), [F.col("a")], {"w": 1.5, "bias": 0.5})
    return _x(spark, sf_dir).agg(*(r(c, name=n) for n, c in grads.items()))


@query("m72_calibration", f"WITH {_X} SELECT flag, round(avg(1/(1+exp(-greatest(least(b*4/2.0,60),-60)))), 6) AS p FROM x GROUP BY flag")
def calibration(spark, sf_dir):
    return _x(spark, sf_dir).groupBy("flag").agg(r(F.avg(G.sigmoid(F.col("b") * 4 / 2.0)), name="p"))


@query("m72_softmax", f"""WITH {_X}, m AS (SELECT flag, a, b, c, greatest(a, b, c) AS g FROM x), e AS (SELECT flag, exp(a-g) AS ea, exp(b-g) AS eb, exp(c-g) AS ec FROM m)
    SELECT flag, round(avg(ea/(ea+eb+ec)), 6) AS pa, round(avg(eb/(ea+eb+ec)), 6) AS pb, round(avg(ec/(ea+eb+ec)), 6) AS pc FROM e GROUP BY flag""")  # fmt: skip
def softmax(spark, sf_dir):
    top = F.greatest("a", "b", "c")
    e = {n: F.exp(F.col(n) - top) for n in "abc"}
    total = e["a"] + e["b"] + e["c"]
    return _x(spark, sf_dir).groupBy("flag").agg(*(r(F.avg(v / total), name=f"p{n}") for n, v in e.items()))


@query("m73_normal_logprob", f"WITH {_X} SELECT flag, round(avg(-0.5*ln(2*pi()) - ln(0.5+a) - 0.5*((t-a)/(0.5+a))*((t-a)/(0.5+a))), 6) AS logp FROM x GROUP BY flag")
def normal_logprob(spark, sf_dir):
    s = 0.5 + F.col("a")
    z = (F.col("t") - F.col("a")) / s
    return _x(spark, sf_dir).groupBy("flag").agg(r(F.avg(-0.5 * F.ln(2 * F.pi()) - F.ln(s) - 0.5 * z * z), name="logp"))


@query("m73_poisson_logprob", f"WITH {_X}, z AS (SELECT flag, round(a) AS y, greatest(ln(1+exp(-abs(b)))+greatest(b,0), 1e-8) AS r FROM x) SELECT flag, round(avg(y*ln(r) - r - CASE WHEN y <= 0 THEN 0 ELSE y*ln(y) - y + 0.5*ln(2*pi()*y + 1.0/3) END), 6) AS logp FROM z GROUP BY flag")
def poisson_logprob(spark, sf_dir):
    y = F.round("a")
    return _x(spark, sf_dir).groupBy("flag").agg(r(F.avg(D.poisson(y, D.positive(F.col("b")))), name="logp"))


_LG = "(({0}-0.5)*ln({0}) - {0} + 0.5*ln(2*pi()) + 1/(12*{0}))"


@query("m73_negbin_logprob", f"""WITH {_X}, z AS (SELECT flag, round(a) AS y, greatest(c, 1e-8) AS m, greatest(exp(greatest(least(b, 50), -50)), 1e-8) AS al FROM x), q AS (SELECT flag, y, 1/al AS s, 1/(1+al*m) AS h FROM z)
    SELECT flag, round(avg({_LG.format('(y+s)')} - {_LG.format('(y+1)')} - {_LG.format('s')} + y*ln(1-h) + s*ln(h)), 6) AS logp FROM q WHERE h < 1 GROUP BY flag""")  # fmt: skip
def negbin_logprob(spark, sf_dir):
    mean, alpha = F.col("c"), D.positive(F.col("b"), "exp")
    inside = 1 / (1 + alpha * F.greatest(mean, F.lit(1e-8))) < 1
    return _x(spark, sf_dir).where(inside).groupBy("flag").agg(r(F.avg(D.negative_binomial(F.round("a"), mean, alpha)), name="logp"))


_SPECS = [
    {"name": "gate", "family": "gate_binary", "source": "a", "threshold": 2.5, "positive": 3.0, "negative": 1.0},
    {"name": "hot", "family": "gate_onehot", "source": "a", "categories": ["2", "none"], "slope": 4},
    {"name": "hinge", "family": "piecewise_hinge", "source": "b", "cut": 0.25, "direction": "negative"},
    {"name": "step", "family": "gate_step", "source": "c", "cut": 2.0, "multiplier": "a"},
    {"name": "bent", "family": "piecewise", "source": "a", "cut": 2.0, "left": "abs", "right": "square"},
    {"name": "flat", "family": "piecewise", "source": "b", "left": "off", "right": "left_hinge"},
    {"name": "again", "family": "gate_soft", "source": "c", "cut": 2.0, "multiplier": "a"},
    {"name": "lost", "family": "gate_step", "source": "missing"},
]
_STEP = "(0.5*(1+tanh({s}*({x}-({c})))))"


@query("m65_conditional", f"""WITH {_X} SELECT flag, round(avg(1 + 2*{_STEP.format(s=8, x='a', c=2.5)}), 6) AS gate, round(avg({_STEP.format(s=4, x='a', c=1.5)}*(1-{_STEP.format(s=4, x='a', c=2.5)})), 6) AS hot, round(avg(greatest(0.25-b, 0)), 6) AS hinge,
    round(avg({_STEP.format(s=8, x='c', c=2)}*a), 6) AS step, round(avg((1-{_STEP.format(s=8, x='a', c=2)})*abs(a-2) + {_STEP.format(s=8, x='a', c=2)}*(a-2)*(a-2)), 6) AS bent, round(avg({_STEP.format(s=8, x='b', c=0)}*greatest(-b, 0)), 6) AS flat FROM x GROUP BY flag""")  # fmt: skip
def conditional(spark, sf_dir):
    """Six of the eight: one names no feature, one is the same expression as another."""
    cols = [F.col("a"), F.col("b"), F.col("c")]
    terms = C.lower(_SPECS, ["a", "b", "c"])
    return _x(spark, sf_dir).groupBy("flag").agg(*(r(F.avg(X.to_column(e, cols)), name=n.split(":")[0]) for n, e, _, _ in terms))


@query("m3_parameterized", f"WITH {_X} SELECT flag, round(avg(0.5 + 2*sin(3*a + 0.25)), 6) AS value FROM x GROUP BY flag")
def parameterized(spark, sf_dir):
    expr = X.parameterize(X.un("sin", X.feature(0)), "p")
    values = X.bind([expr], [3.0, 0.25, 0.5, 2.0])
    return _x(spark, sf_dir).groupBy("flag").agg(r(F.avg(X.to_column(expr, [F.col("a")], values)), name="value"))


@query("m74_interval_heads", f"""WITH {_X} SELECT flag, round(avg(least(a,b)), 6) AS lo, round(avg(greatest(a,b)), 6) AS hi,
    round(avg(a - ln(1+exp(b))), 6) AS center_lo, round(avg(a + ln(1+exp(b))), 6) AS center_hi FROM x GROUP BY flag""")  # fmt: skip
def interval_heads(spark, sf_dir):
    radius = F.log1p(F.exp("b"))
    return _x(spark, sf_dir).groupBy("flag").agg(
        r(F.avg(F.least("a", "b")), name="lo"), r(F.avg(F.greatest("a", "b")), name="hi"), r(F.avg(F.col("a") - radius), name="center_lo"), r(F.avg(F.col("a") + radius), name="center_hi")
    )


@query("p3_zscore", f"""WITH {_X}, s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(t) AS mt, stddev_pop(t) AS st FROM x WHERE k % 5 <> 0)
    SELECT k, n, round((a-ma)/sa, 6) AS a, round((t-mt)/st, 6) AS t FROM x, s""")  # fmt: skip
def zscore(spark, sf_dir):
    x = _x(spark, sf_dir).withColumn("split", F.when(F.col("k") % 5 == 0, "valid").otherwise("train"))
    return prep.zscore(x, ["a", "t"], "split").select("k", "n", r("a"), r("t"))


@query("p2_select_columns", f"WITH {_X} SELECT t, a, t AS t_1 FROM x")
def select_columns(spark, sf_dir):
    return prep.select_columns(_x(spark, sf_dir), [7, 4, 7])


@query("p11_polynomial", f"WITH {_X} SELECT k, n, round(a*a, 6) AS aa, round(b*b, 6) AS bb, round(a*b, 6) AS ab, round(a*c, 6) AS ac, round(b*c, 6) AS bc FROM x")
def polynomial(spark, sf_dir):
    out = prep.polynomial(_x(spark, sf_dir), ["a", "b", "c"])
    return out.select("k", "n", r("a^2", name="aa"), r("b^2", name="bb"), r("a*b", name="ab"), r("a*c", name="ac"), r("b*c", name="bc"))


@query("p8_conditioned_target", f"WITH {_X} SELECT k, n, round(t - a, 6) AS residual, round(a, 6) AS prediction FROM x")
def conditioned_target(spark, sf_dir):
    out = prep.conditioned_target(_x(spark, sf_dir), "t", "a", append_prediction=True)
    return out.select("k", "n", r("`t.residual`", name="residual"), r("`reference.prediction`", name="prediction"))


@query("p16_blend", f"WITH {_X} SELECT k, n, round(0.25 + 0.5*a - 0.2*b + 0.1*c, 6) AS prediction FROM x")
def blend(spark, sf_dir):
    return prep.blend(_x(spark, sf_dir), {"a": 0.5, "b": -0.2, "c": 0.1}, 0.25).select("k", "n", r("prediction"))


@query("e2_one_hot", """SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 1.0 ELSE 0.0 END AS is_f, CASE WHEN o_orderstatus='O' THEN 1.0 ELSE 0.0 END AS is_o,
    CASE WHEN o_orderstatus='P' THEN 1.0 ELSE 0.0 END AS is_p FROM orders""")  # fmt: skip
def one_hot(spark, sf_dir):
    out = prep.one_hot(read(spark, sf_dir, "orders"), "o_orderstatus")
    return out.select("o_orderkey", F.col("`o_orderstatus=F`").alias("is_f"), F.col("`o_orderstatus=O`").alias("is_o"), F.col("`o_orderstatus=P`").alias("is_p"))


_RANKED = "SELECT {k} AS id, row_number() OVER (ORDER BY (({k} * 2654435761 + {seed}) % 4294967296), {k}) - 1 AS pos, count(*) OVER () AS n FROM {t}"
_SCHEMA = [{"key": "c_acctbal", "dtype": "float"}, {"key": "rich", "dtype": "bool"}, {"key": "c_mktsegment", "dtype": "category"}, {"key": "tier", "dtype": "string", "vocab": ["0", "1"]}, {"key": "gone", "dtype": "float"}]
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("e3_numericizer", f"""SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END AS rich, {', '.join(f"CASE WHEN c_mktsegment = '{v}' THEN 1.0 ELSE 0.0 END AS {v.lower()}" for v in _SEGMENTS)},
    CASE WHEN c_nationkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS tier0, CASE WHEN c_nationkey % 3 = 1 THEN 1.0 ELSE 0.0 END AS tier1, 0.0 AS gone, CAST(c_nationkey AS DOUBLE) AS target FROM customer""")  # fmt: skip
def numericizer(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") > 5000).alias("rich"), "c_mktsegment", (F.col("c_nationkey") % 3).alias("tier"), "c_nationkey")
    plan = prep.fit_numeric(rows, prep.numeric_plan(_SCHEMA, "c_nationkey"))
    out = prep.transform_numeric(rows, plan, keep=["c_custkey"])
    hot = [F.col(f"`c_mktsegment={v}`").alias(v.lower()) for v in _SEGMENTS]
    return out.select("c_custkey", "c_acctbal", "rich", *hot, F.col("`tier=0`").alias("tier0"), F.col("`tier=1`").alias("tier1"), "gone", F.col("c_nationkey").alias("target"))


@query("t12_batch_schedule", f"WITH o AS ({_RANKED.format(k='o_orderkey', seed=43, t='orders')}) SELECT id AS o_orderkey, 1 AS epoch, CAST(2 AS BIGINT) AS batch_id FROM o WHERE pos // 64 = 2")
def batch_schedule(spark, sf_dir):
    """The third batch of the second epoch, from a restored checkpoint."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey")
    schedule = prep.BatchSchedule(rows, "o_orderkey", 64, shuffle=True, drop_last=True)
    schedule.restore({**schedule.state(), "epoch": 1, "cursor": 2})
    return schedule.next()


@query("e6_categorical_code", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def categorical_code(spark, sf_dir):
    return prep.categorical_code(read(spark, sf_dir, "customer"), "c_mktsegment").select("c_custkey", "code")


@query("t13_train_valid_split", f"WITH o AS ({_RANKED.format(k='o_orderkey', seed=7, t='orders')}) SELECT id AS o_orderkey, CASE WHEN pos < greatest(1, round_even(0.2*n, 0)) THEN 'valid' ELSE 'train' END AS split FROM o")
def train_valid(spark, sf_dir):
    return prep.train_valid_split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.2, 7)


@query("t15_k_fold", f"WITH o AS ({_RANKED.format(k='o_orderkey', seed=42, t='orders')}) SELECT id AS o_orderkey, CAST(ntile(7) OVER (ORDER BY pos) - 1 AS BIGINT) AS fold FROM o")
def k_fold(spark, sf_dir):
    return prep.k_fold(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("t11_batches", f"WITH o AS ({_RANKED.format(k='o_orderkey', seed=45, t='orders')}) SELECT id AS o_orderkey, CAST(pos // 64 AS BIGINT) AS batch_id FROM o WHERE pos // 64 < n // 64")
def batches(spark, sf_dir):
    return prep.batches(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64, shuffle=True, epoch=3, drop_last=True)


@query("s4_row_stream", "SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 32 AS BIGINT) AS batch_id FROM customer")
def row_stream(spark, sf_dir):
    return prep.batches(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 32)


@query("w28_routes", f"""WITH {_X}, z AS (SELECT a, t, (CASE WHEN a >= 1 THEN 1 ELSE 0 END) + (CASE WHEN a >= 2.5 THEN 1 ELSE 0 END) + (CASE WHEN a >= 4 THEN 1 ELSE 0 END) AS route FROM x)
    SELECT route, count(*) AS n, round(avg(CASE WHEN route = 0 THEN a WHEN route = 1 THEN a*a ELSE t END), 6) AS pred FROM z GROUP BY route""")  # fmt: skip
def routes(spark, sf_dir):
    route = prep.route_by_thresholds(F.col("a"), [1.0, 2.5, 4.0])
    pred = prep.piecewise(F.col("route"), {0: F.col("a"), 1: F.col("a") * F.col("a")}, F.col("t"))
    return _x(spark, sf_dir).withColumn("route", route).groupBy("route").agg(F.count("*").alias("n"), r(F.avg(pred), name="pred"))


@query("f4_quantile_branches", f"""WITH {_X}, q AS (SELECT min(a) AS q0, quantile_cont(a, 0.5) AS q1, max(a) AS q2 FROM x),
    z AS (SELECT 0 AS bucket, t FROM x, q WHERE a BETWEEN q0 AND q1 UNION ALL SELECT 1, t FROM x, q WHERE a BETWEEN q1 AND q2)
    SELECT bucket, count(*) AS n, round(avg(t), 6) AS mean_t FROM z GROUP BY bucket""")  # fmt: skip
def quantile_branches(spark, sf_dir):
    out = prep.quantile_buckets(_x(spark, sf_dir), "a", [0.0, 0.5, 1.0])
    return out.groupBy("bucket").agg(F.count("*").alias("n"), r(F.avg("t"), name="mean_t"))


@query("f2_close_filter", f"WITH {_X} SELECT count(*) AS n FROM x WHERE abs(a*10 - t*10) <= 1e-8 + 1e-1*abs(t*10)")
def close_filter(spark, sf_dir):
    return _x(spark, sf_dir).where(G.isclose(F.col("a") * 10, F.col("t") * 10, rtol=1e-1)).agg(F.count("*").alias("n"))


_CORR = "round(CASE WHEN stddev_pop({0}) > 1e-12 AND stddev_pop({1}) > 1e-12 THEN covar_pop({0}, {1})/(stddev_pop({0})*stddev_pop({1})) ELSE 0 END, 6)"


def _sql_terms(columns: str) -> dict[str, tuple[str, str, float, list[int]]]:
    """SQL, family, cost and features of every candidate over ``columns``."""
    out = {}
    for i, c in enumerate(columns):
        for n in P.named(initial=True):
            out[f"{n}({c})"] = (re.sub(r"\bz\b", c, _SQL_UNARY[n]), P.UNARY[n].family, P.UNARY[n].cost, [i])
    for i, p in enumerate(columns):
        for j, q in list(enumerate(columns))[i + 1 :]:
            for n in P.named(initial=True, pairs=True):
                sql = re.sub(r"\b[ab]\b", lambda m, p=p, q=q: p if m[0] == "a" else q, _SQL_PAIR[n])
                out[f"{n}({p},{q})"] = (sql, P.PAIR[n].family, P.PAIR[n].cost, [i, j])
    return out


_TERMS = _sql_terms("abc")
_LISTED = ", ".join(f"{{'name': '{n}', 'family': '{t[1]}', 'complexity': {t[2]}, 'prior_corr': {_CORR.format('(' + t[0] + ')', 't')}}}" for n, t in _TERMS.items())
_POOL = f"{_X}, pool AS (SELECT unnest(p, max_depth := 1) FROM (SELECT unnest([{_LISTED}]) AS p FROM x))"


def _pool(spark, sf_dir):
    return pool.score(_x(spark, sf_dir), pool.candidates(["a", "b", "c"]), "t").withColumn("prior_corr", F.round("prior_corr", 6))


@query("a30_prior_corr", f"WITH {_POOL} SELECT name, prior_corr FROM pool")
def prior_corr(spark, sf_dir):
    return _pool(spark, sf_dir).select("name", "prior_corr")


@query("t2_top_by_corr", f"WITH {_POOL} SELECT name, family, prior_corr FROM pool ORDER BY abs(prior_corr) DESC, complexity, name LIMIT 10")
def top_by_corr(spark, sf_dir):
    return pool.top_by_corr(_pool(spark, sf_dir), 10).select("name", "family", "prior_corr")


@query("t6_family_quota", f"""WITH {_POOL}, k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY abs(prior_corr) DESC, complexity, name) AS place FROM pool)
    SELECT name, family, prior_corr FROM k WHERE place <= CASE family WHEN 'trig' THEN 2 WHEN 'safe_log' THEN 1 WHEN 'interaction_ratio' THEN 3 ELSE 1000000 END""")  # fmt: skip
def family_quota(spark, sf_dir):
    return pool.family_quota(_pool(spark, sf_dir), {"trig": 2, "safe_log": 1, "interaction_ratio": 3}).select("name", "family", "prior_corr")


@query("f12_min_corr", f"WITH {_POOL} SELECT name FROM pool WHERE abs(prior_corr) >= 0.003 OR family = 'gate'")
def min_corr(spark, sf_dir):
    return pool.min_corr(_pool(spark, sf_dir), 0.003).select("name")


@query("f13_by_family", f"WITH {_POOL} SELECT name, complexity FROM pool WHERE family = 'trig'")
def by_family(spark, sf_dir):
    return pool.by_family(_pool(spark, sf_dir), "trig").select("name", "complexity")


_USED = ", ".join(f"('{n}', '{t[1]}', {t[3]})" for n, t in _TERMS.items())


@query("a27_frequency", f"""WITH p(name, family, features) AS (VALUES {_USED}) SELECT 'family' AS kind, family AS value, count(*) AS n FROM p GROUP BY 2
    UNION ALL SELECT 'feature', CAST(f AS VARCHAR), count(*) FROM (SELECT unnest(features) AS f FROM p) GROUP BY 2""")  # fmt: skip
def term_frequency(spark, sf_dir):
    return pool.frequency(_pool(spark, sf_dir))


@query("a37_feature_reuse", f"WITH p(name, family, features) AS (VALUES {_USED}) SELECT CAST(f AS INT) AS feature, count(*) AS terms FROM (SELECT unnest(features) AS f FROM p) GROUP BY 1")
def feature_reuse(spark, sf_dir):
    return guards.feature_reuse(_pool(spark, sf_dir))


_NAMES = list(_TERMS)
_PAIRED = ", ".join(f"{{'a': '{p}', 'b': '{q}', 'corr': {_CORR.format('(' + _TERMS[p][0] + ')', '(' + _TERMS[q][0] + ')')}}}" for i, p in enumerate(_NAMES) for q in _NAMES[i + 1 :])


@query("j11_correlation_pairs", f"WITH {_X}, p AS (SELECT unnest(p, max_depth := 1) FROM (SELECT unnest([{_PAIRED}]) AS p FROM x)) SELECT * FROM p WHERE abs(corr) >= 0.05")
def correlation_pairs(spark, sf_dir):
    """All pairs of the pool's candidates."""
    out = pool.correlation_pairs(_x(spark, sf_dir), {t[0]: t[4] for t in pool.candidates(["a", "b", "c"])})
    return out.select("a", "b", r("corr")).where(F.abs("corr") >= 0.05)


@query("t9_prune_redundant", None)
def prune_redundant(spark, sf_dir):
    x, terms = _x(spark, sf_dir), pool.candidates(["a", "b"])
    pairs = pool.correlation_pairs(x, {t[0]: G.finite(t[4]) for t in terms})
    return pool.prune_redundant(pool.score(x, terms, "t"), pairs, 0.95).select("name", r("prior_corr"))


@query("a29_value_overlap", f"""WITH {_X}, p AS (SELECT unnest([{{'a': 'first', 'b': 'second', 'artifact_a': 'one', 'artifact_b': 'one', 'c': {_CORR.format('a', '(a*a)')}}}, {{'a': 'first', 'b': 'third', 'artifact_a': 'one', 'artifact_b': 'two', 'c': {_CORR.format('a', '(a+b)')}}},
    {{'a': 'second', 'b': 'third', 'artifact_a': 'one', 'artifact_b': 'two', 'c': {_CORR.format('(a*a)', '(a+b)')}}}]) AS p FROM x) SELECT p.a AS a, p.b AS b, p.artifact_a AS artifact_a, p.artifact_b AS artifact_b, abs(p.c) AS abs_corr, abs(p.c) >= 0.9 AS high FROM p""")  # fmt: skip
def value_overlap(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return moments.value_overlap(_x(spark, sf_dir), [("one", "first", a), ("one", "second", a * a), ("two", "third", a + b)], 0.9).withColumn("abs_corr", F.round("abs_corr", 6))


_BASIS = "m AS (SELECT var_pop(a) AS u, var_pop(a*a) AS v, covar_pop(a, a*a) AS c FROM x), g AS (SELECT u + v AS tr, sqrt((u-v)*(u-v) + 4*c*c) AS gap, abs(c)/sqrt(u*v) AS r FROM m)"


@query("a31_basis_metrics", f"WITH {_X}, {_BASIS} SELECT round(r, 6) AS max_abs_corr, round(r, 6) AS mean_abs_corr, 2.0 AS rank, round(sqrt((tr+gap)/(tr-gap)), 3) AS condition FROM g")
def basis_metrics(spark, sf_dir):
    out = moments.basis_metrics(_x(spark, sf_dir), [F.col("a"), F.col("a") * F.col("a")])
    return out.select(r("max_abs_corr"), r("mean_abs_corr"), "rank", r("condition", 3))


@query("a32_basis_metrics_all", f"WITH {_X}, {_BASIS} SELECT round(r, 6) AS max_abs_corr, round(r/2, 6) AS mean_abs_corr, 2.0 AS rank FROM g")
def basis_metrics_all(spark, sf_dir):
    out = moments.basis_metrics(_x(spark, sf_dir), [F.col("a"), F.col("a") * F.col("a")], mean_over_all=True)
    return out.select(r("max_abs_corr"), r("mean_abs_corr"), "rank")


_STABLE = """q AS (SELECT quantile_cont(v, 0.1) AS q10, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.9) AS q90, stddev_pop(v) AS std, stddev_pop(s) AS step_std FROM (SELECT a*b AS v, a*b - lag(a*b) OVER (ORDER BY k, n, a*b) AS s FROM x)),
    z AS (SELECT *, greatest(1.0, abs(q50), std) AS size FROM q)"""


@query("a34_stability", f"WITH {_X}, {_STABLE} SELECT round(q10, 6) AS q10, round(q50, 6) AS q50, round(q90, 6) AS q90, round(std, 6) AS std, round(step_std, 6) AS step_std, round(1/(1 + 0.35*least(10, abs(q90-q10)/size) + 0.45*least(10, step_std/size)), 6) AS score FROM z")
def stability(spark, sf_dir):
    x = _x(spark, sf_dir).withColumn("o", F.struct("k", "n", F.col("a") * F.col("b")))
    out = pool.stability(x, F.col("a") * F.col("b"), "o")
    return out.select(r("q10"), r("q50"), r("q90"), r("std"), r("step_std"), r("score"))


@query("a39_overfit_guard", """WITH s AS (SELECT l_suppkey AS g, avg(CASE WHEN l_orderkey % 5 <> 0 THEN l_tax END) AS tr, avg(CASE WHEN l_orderkey % 5 = 0 THEN l_tax END) AS va FROM lineitem GROUP BY 1)
    SELECT g, round(va - tr, 6) AS gap, round(va / greatest(abs(tr), 1e-12), 6) AS ratio, greatest(va - tr - 0.001, 0) + greatest(va / greatest(abs(tr), 1e-12) - 1.1, 0) <= 0 AS passes FROM s WHERE va IS NOT NULL AND tr IS NOT NULL""")  # fmt: skip
def overfit_guard(spark, sf_dir):
    x, valid = read(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 5 == 0
    scores = x.groupBy(F.col("l_suppkey").alias("g")).agg(F.avg(F.when(~valid, F.col("l_tax"))).alias("tr"), F.avg(F.when(valid, F.col("l_tax"))).alias("va")).dropna()
    return pool.overfit_guard(scores, "tr", "va", 0.001, 1.1).select("g", r("gap"), r("ratio"), "passes")


_ALL_KEYS = "terms AS (SELECT DISTINCT l_suppkey % 10 AS artifact, p_name AS key FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _keys(spark, sf_dir):
    items, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return items.join(parts, items["l_partkey"] == parts["p_partkey"]).select((F.col("l_suppkey") % 10).alias("artifact"), F.col("p_name").alias("key")).distinct()


@query("a26_consensus", f"WITH {_ALL_KEYS}, n AS (SELECT count(DISTINCT artifact) AS c FROM terms) SELECT key, count(DISTINCT artifact) AS support, round(count(DISTINCT artifact) / max(c), 6) AS ratio, count(DISTINCT artifact) >= ceil(0.9 * max(c)) AS agreed FROM terms, n GROUP BY key")
def consensus(spark, sf_dir):
    return pool.consensus(_keys(spark, sf_dir), 0.9).select("key", "support", r("ratio"), "agreed")


@query("a28_overlap", f"""WITH {_ALL_KEYS}, n AS (SELECT artifact, count(*) AS n FROM terms GROUP BY 1), s AS (SELECT l.artifact AS a, r.artifact AS b, count(*) AS c FROM terms l JOIN terms r ON l.key = r.key AND l.artifact < r.artifact GROUP BY 1, 2)
    SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM s JOIN n x ON x.artifact = a JOIN n y ON y.artifact = b""")  # fmt: skip
def overlap(spark, sf_dir):
    return pool.overlap(_keys(spark, sf_dir)).select("a", "b", r("jaccard"))


@query("j10_pool_changes", """WITH b AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_shipdate < DATE '1998-01-01'), a AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_shipdate >= DATE '1998-01-01')
    SELECT p || '-' || s AS key, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT p || '-' || s, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")  # fmt: skip
def pool_changes(spark, sf_dir):
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("date")
    x = read(spark, sf_dir, "lineitem")
    part = lambda where: x.where(where).select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("key"))
    return pool.changes(part(early), part(~early), "key")


