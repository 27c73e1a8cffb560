"""Queries over pools as a whole, linear maps, presets, graphs and simplex projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import primitives as P
from quern.operators import catalog, linear, pool, prep, presets
from quern.plans.feature_queries import _POOL, _X, _pool, _x
from quern.plans.tables import ENTRIES, entries, r, read
from quern.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_BUDGET = "CASE family WHEN 'trig' THEN 2 WHEN 'interaction_ratio' THEN 1 ELSE 1000000 END"


@query("m70_pool_build", f"""WITH {_POOL}, k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY abs(prior_corr) DESC, complexity, name) AS place FROM pool)
    SELECT name, family, prior_corr FROM k WHERE place <= {_BUDGET} ORDER BY abs(prior_corr) DESC, complexity, name LIMIT 20""")  # fmt: skip
def pool_build(spark, sf_dir):
    out = pool.build(_x(spark, sf_dir), ["a", "b", "c"], "t", {"trig": 2, "interaction_ratio": 1}, 20)
    return out.select("name", "family", r("prior_corr"))


@query("a46_lane_blend", f"WITH {_X} SELECT k, n, round((2*a - b + c)/4, 6) AS prediction FROM x")
def lane_blend(spark, sf_dir):
    return pool.lane_blend(_x(spark, sf_dir), {"a": 2.0, "b": -1.0, "c": 1.0}).select("k", "n", r("prediction"))


@query("a56_rank_agreement", f"""WITH {_POOL}, u AS (SELECT name FROM pool ORDER BY abs(prior_corr) DESC, name LIMIT 10), v AS (SELECT name FROM pool ORDER BY abs(prior_corr / complexity) DESC, name LIMIT 10)
    SELECT count(*) AS shared, count(*) / 10 AS agreement FROM u JOIN v USING (name)""")  # fmt: skip
def rank_agreement(spark, sf_dir):
    found = _pool(spark, sf_dir)
    return pool.rank_agreement(found, found.withColumn("prior_corr", F.col("prior_corr") / F.col("complexity")), "name", "prior_corr", 10)


_PCA = """m AS (SELECT avg(a) AS ma, avg(t) AS mt, var_pop(a) AS u, var_pop(t) AS v, covar_pop(a, t) AS c FROM x), e AS (SELECT *, (u+v+sqrt((u-v)*(u-v)+4*c*c))/2 AS l FROM m),
    w AS (SELECT *, CASE WHEN abs(c) >= abs(l-u) THEN sign(c) ELSE sign(l-u) END AS s, sqrt(c*c+(l-u)*(l-u)) AS z FROM e)"""


@query("a50_orthogonal_map", f"WITH {_X}, {_PCA} SELECT k, n, round(((x.a-ma)*w.c + (x.t-mt)*(l-u))*s/z, 5) AS q0, round(l/(u+v), 6) AS energy FROM x, w")
def orthogonal_map(spark, sf_dir):
    x = _x(spark, sf_dir)
    fitted = linear.fit_orthogonal(x, [F.col("a"), F.col("t")], 0.5)
    (q0,) = fitted.columns([F.col("a"), F.col("t")])
    return x.select("k", "n", r(q0, 5, "q0"), F.lit(round(fitted.energy, 6)).alias("energy"))


@query("m75_linear_gradient", f"WITH {_X} SELECT round(2*avg(0.5+1.5*a-b-t), 6) AS g0, round(2*avg(a*(0.5+1.5*a-b-t)) + 0.03, 6) AS ga, round(2*avg(b*(0.5+1.5*a-b-t)) - 0.02, 6) AS gb FROM x")
def linear_gradient(spark, sf_dir):
    out = linear.gradient(_x(spark, sf_dir), [F.col("a"), F.col("b")], F.col("t"), [1.5, -1.0], 0.5, 0.01)
    return out.select(r("intercept", name="g0"), r(F.col("weights")[0], name="ga"), r(F.col("weights")[1], name="gb"))


@query("q40_linear_preset", f"WITH {_X}, f AS (SELECT regr_intercept(t, a) AS i, regr_slope(t, a) AS s FROM x) SELECT k, n, round(i + s*a, 4) AS prediction FROM x, f")
def linear_preset(spark, sf_dir):
    x = _x(spark, sf_dir)
    return presets.predict(presets.fit(x, ["a"], "t", "linear"), x).select("k", "n", r("prediction", 4))


@query("q45_sparsemax", f"""WITH {_X}, s AS (SELECT k, n, a, b, c, greatest(a, b, c) AS z1, least(a, b, c) AS z3, a + b + c - greatest(a, b, c) - least(a, b, c) AS z2 FROM x),
    q AS (SELECT *, CASE WHEN 1 + 3*z3 > z1+z2+z3 THEN (z1+z2+z3-1)/3 WHEN 1 + 2*z2 > z1+z2 THEN (z1+z2-1)/2 ELSE z1 - 1 END AS cut FROM s)
    SELECT k, n, round(greatest(a-cut, 0), 6) AS pa, round(greatest(b-cut, 0), 6) AS pb, round(greatest(c-cut, 0), 6) AS pc FROM q""")  # fmt: skip
def sparsemax(spark, sf_dir):
    p = _x(spark, sf_dir).select("k", "n", prep.sparsemax(F.array("a", "b", "c")).alias("p"))
    return p.select("k", "n", r(F.col("p")[0], name="pa"), r(F.col("p")[1], name="pb"), r(F.col("p")[2], name="pc"))


@query("q47_masked_mean", "SELECT l_returnflag, round(coalesce(avg(CASE WHEN l_tax > 0.04 THEN l_quantity END), 0), 6) AS mean FROM lineitem GROUP BY 1")
def masked_mean(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("m", F.col("l_tax") > 0.04)
    return prep.masked_mean(rows, "l_returnflag", "l_quantity", "m").select("l_returnflag", r("mean"))


@query("q47_normalized_edges", """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey + 1000000000 AS d FROM lineitem), v AS (SELECT s AS x FROM e UNION SELECT d FROM e), a AS (SELECT s, d FROM e UNION ALL SELECT x, x FROM v), g AS (SELECT s, count(*) AS n FROM a GROUP BY 1)
    SELECT a.s AS src, a.d AS dst, round(1/sqrt(CAST(p.n AS DOUBLE)*q.n), 6) AS weight FROM a JOIN g p ON p.s = a.s JOIN g q ON q.s = a.d""")  # fmt: skip
def normalized_edges(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000000).alias("dst"))
    return prep.normalized_edges(edges).select("src", "dst", r("weight"))


@query("f3_predicates", f"WITH {_X} SELECT CAST(sum(CASE WHEN a > 2 THEN 1 ELSE 0 END) AS BIGINT) AS above, CAST(sum(CASE WHEN abs(b) <= 1e-8 THEN 1 ELSE 0 END) AS BIGINT) AS zero, CAST(sum(CASE WHEN c BETWEEN 1 AND 2 THEN 1 ELSE 0 END) AS BIGINT) AS inside, CAST(sum(CASE WHEN k IN (1, 5, 7) THEN 1 ELSE 0 END) AS BIGINT) AS listed, count(*) AS n FROM x")
def predicates(spark, sf_dir):
    count = lambda spec, c, name: F.count_if(prep.predicate(spec, F.col(c), F.col("k"))).alias(name)
    return _x(spark, sf_dir).agg(
        count({"kind": "threshold", "op": ">", "value": 2}, "a", "above"), count({"kind": "threshold", "op": "==", "value": 0}, "b", "zero"),
        count({"kind": "range", "low": 1, "high": 2}, "c", "inside"), count({"kind": "indices", "indices": [1, 5, 7]}, "a", "listed"), count({}, "a", "n"),
    )


@query("f10_profile", f"WITH {ENTRIES} SELECT key FROM entries WHERE NOT list_contains(tags, 'red') AND NOT list_contains(tags, 'blue')")
def profile(spark, sf_dir):
    return entries(spark, sf_dir).where(catalog.in_profile(F.col("tags"), ["red", "blue"])).select("key")


@query("q21_stages", """WITH s AS (SELECT CASE lower(p_type) WHEN 'economy' THEN 'first' WHEN 'standard' THEN 'second' ELSE 'third' END AS stage FROM part)
    SELECT stage, CASE stage WHEN 'first' THEN 1 WHEN 'second' THEN 2 ELSE 3 END AS place, CASE stage WHEN 'first' THEN 'second' WHEN 'second' THEN 'third' END AS next, count(*) AS n FROM s GROUP BY 1""")  # fmt: skip
def stages(spark, sf_dir):
    return catalog.stages(entries(spark, sf_dir), {"economy": "first", "standard": "second"}, ["first", "second", "third"], "third")


@query("s19_sine_windows", "WITH s AS (SELECT o_orderkey AS t, sin(0.1 * o_orderkey) AS y FROM orders) SELECT t, round(lag_0, 6) AS lag_0, round(lag_2, 6) AS lag_2, round(y, 6) AS target FROM (SELECT t, y, lag(y, 3) OVER (ORDER BY t) AS lag_0, lag(y) OVER (ORDER BY t) AS lag_2 FROM s) WHERE lag_0 IS NOT NULL")
def sine_windows(spark, sf_dir):
    """Windows of three of a wave at the orders' places, whose rows no single task sees all."""
    wave = readers.sine(spark, frequency=0.1, at=read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t")))
    return readers.sine_windows(wave, "y", "t", 3).select("t", r("lag_0"), r("lag_2"), r("target"))


@query("s5_named_columns", "SELECT role, conv_id, turn FROM conversations")
def named_columns(spark, sf_dir):
    return readers.named_columns(read(spark, sf_dir, "conversations"), ["role", "conv_id", "turn"])


@query("a22_edge_counters", """SELECT l_returnflag AS namespace, l_linestatus AS src, l_linenumber AS op, l_suppkey % 10 AS expr, l_partkey % 3 AS dst, count(*) AS seen, CAST(sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS BIGINT) AS success,
    CAST(sum(CASE WHEN l_tax > 0.04 THEN 0 ELSE 1 END) AS BIGINT) AS failure, round(sum(l_quantity), 3) AS score_sum FROM lineitem GROUP BY 1, 2, 3, 4, 5""")  # fmt: skip
def edge_counters(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("namespace"), F.col("l_linestatus").alias("src"), F.col("l_linenumber").alias("op"), (F.col("l_suppkey") % 10).alias("expr"), (F.col("l_partkey") % 3).alias("dst"), "l_tax", "l_quantity"
    )
    return catalog.edge_counters(x, F.col("l_tax") > 0.04, F.col("l_quantity")).withColumn("score_sum", F.round("score_sum", 3))


@query("m63_gates_from_specs", f"WITH {_X} SELECT flag, round(avg(CASE WHEN a >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS g0, round(avg(1/(1+exp(-(b-0.25)/0.5))), 6) AS g1, round(avg(greatest(2-c, 0)), 6) AS g2, round(avg(CASE WHEN a = 1.5 THEN 1.0 ELSE 0.0 END), 6) AS g3, round(avg(CASE WHEN a = 3.0 THEN 1.0 ELSE 0.0 END), 6) AS g4 FROM x GROUP BY flag")
def gates_from_specs(spark, sf_dir):
    specs = ["gate", {"kind": "soft", "feature_index": 1, "threshold": 0.25, "temperature": 0.5}, {"name": "hinge", "params": {"feature_index": 2, "knot": 2.0, "right": False}}, {"name": "onehot", "values": [1.5, 3.0]}]
    made = [c for spec in specs for c in P.from_spec(spec, [F.col("a"), F.col("b"), F.col("c")])]
    return _x(spark, sf_dir).groupBy("flag").agg(*(r(F.avg(c), name=f"g{i}") for i, c in enumerate(made)))


@query("w30_routed_residuals", f"WITH {_X} SELECT flag, round(avg(a + CASE WHEN a >= 4 THEN 0 WHEN a >= 2 THEN b*c ELSE b END), 6) AS routed, round(avg(a + b + b*c), 6) AS every FROM x GROUP BY flag")
def routed_residuals(spark, sf_dir):
    branches = [F.col("b"), F.col("b") * F.col("c")]
    routed = P.with_residual(F.col("a"), branches, prep.route_by_thresholds(F.col("a"), [2.0, 4.0]))
    return _x(spark, sf_dir).groupBy("flag").agg(r(F.avg(routed), name="routed"), r(F.avg(P.with_residual(F.col("a"), branches)), name="every"))


@query("m68_nested_terms", f"WITH {_X} SELECT 'sin(square(a))' AS name, round(CASE WHEN stddev_pop(sin(a*a)) > 0 THEN corr(sin(a*a), t) END, 6) AS prior_corr FROM x UNION ALL SELECT 'tanh(square(a))', round(corr(tanh(a*a), t), 6) FROM x UNION ALL SELECT 'sin(mul(a,b))', round(corr(sin(a*b), t), 6) FROM x UNION ALL SELECT 'tanh(mul(a,b))', round(corr(tanh(a*b), t), 6) FROM x")
def nested_terms(spark, sf_dir):
    inner = [t for t in pool.candidates(["a", "b"]) if t[0] in ("square(a)", "mul(a,b)")]
    return pool.score(_x(spark, sf_dir), pool.nested(inner, ["sin", "tanh"]), "t").select("name", r("prior_corr"))
