"""Queries over scores, penalties, relations with several hops, and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import catalog, guards, metrics, panel, pool, prep, text
from quern.plans.catalog_queries import _HELD, held
from quern.plans.feature_queries import _X, _x
from quern.plans.measure_queries import _FEATURES, _IC, _features
from quern.plans.tables import ENTRIES, LOG, PREDICTIONS, entries, log, predictions, r, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("a35_pole_safety", f"WITH {_X}, v AS (SELECT abs(a / (abs(b) + 0.001)) AS v FROM x), q AS (SELECT quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.95) AS q95, quantile_cont(v, 0.99) AS q99 FROM v) SELECT round(q50, 5) AS q50, round(q95, 5) AS q95, round(q99, 5) AS q99, round(q99 / greatest(q50, 1e-12), 5) AS spread, round(1/(1 + least(20, q99/greatest(q50, 1)/10) + CASE WHEN q95 > 1e6 THEN 1 ELSE 0 END), 5) AS score FROM q")
def pole_safety(spark, sf_dir):
    out = guards.pole_safety(_x(spark, sf_dir), F.col("a") / (F.abs("b") + 0.001))
    return out.select(*(r(c, 5) for c in out.columns))


@query("a36_redundancy", f"WITH {_X}, p AS (SELECT corr(a, a*a) AS c FROM x UNION ALL SELECT corr(a, b) FROM x UNION ALL SELECT corr(a*a, b) FROM x) SELECT CAST(sum(CASE WHEN abs(c) >= 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS redundant, round(max(abs(c)), 6) AS max_corr FROM p")
def redundancy(spark, sf_dir):
    pairs = pool.correlation_pairs(_x(spark, sf_dir), {"a": F.col("a"), "aa": F.col("a") * F.col("a"), "b": F.col("b")})
    return guards.redundancy(pairs, 0.9).select("redundant", r("max_corr"))


@query("a38_structure_penalty", "SELECT p_partkey, round(0.01*greatest(p_size - 24.0, 0) + 0.25*greatest(p_retailprice/100 - 9.5, 0), 6) AS penalty FROM part")
def structure_penalty(spark, sf_dir):
    row = {"complexity": F.col("p_size").cast("double"), "reuse": F.col("p_retailprice") / 100}
    value = guards.structure_penalty(row, {"complexity": 24.0, "reuse": 9.5}, {"complexity": 0.01, "reuse": 0.25})
    return read(spark, sf_dir, "part").select("p_partkey", r(value, name="penalty"))


# Sums in any order are the same after this shift: means of a few dozen values of four digits are no ties with it.
_OFF = 3e-11
_TERM_ROWS = """terms AS (SELECT p_size AS candidate, p_name AS key, CASE p_partkey % 4 WHEN 0 THEN 'trig' WHEN 1 THEN 'gate_interaction' WHEN 2 THEN 'interaction_basic' ELSE 'other' END AS family, CAST(p_partkey % 7 AS DOUBLE) AS complexity,
    p_partkey % 3 AS f1, p_partkey % 5 AS f2, CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 50) / 50.0 END AS stability FROM part)"""


@query("a38_structure_guard", f"""WITH {_TERM_ROWS}, n AS (SELECT *, greatest(0, least(1.25, CASE family WHEN 'trig' THEN 0.75 WHEN 'gate_interaction' THEN 0.55 WHEN 'interaction_basic' THEN 0.7 ELSE 0.35 END - 0.02*greatest(complexity - 4, 0))) AS native FROM terms),
    c AS (SELECT candidate, sum(complexity) AS cx, count(*) - count(DISTINCT key) AS dup, coalesce(min(stability), 1.0) AS st, avg(native) AS native FROM n GROUP BY 1),
    u AS (SELECT candidate, f, count(*) AS n FROM (SELECT candidate, key, unnest(list_distinct([f1, f2])) AS f FROM terms) GROUP BY 1, 2), u2 AS (SELECT candidate, sum(greatest(n - 2, 0)) AS reuse FROM u GROUP BY 1),
    r AS (SELECT candidate, greatest(cx - 24, 0) AS a, greatest(dup, 0) AS b, coalesce(reuse, 0) AS c, greatest(0.12 - st, 0) AS d, native FROM c LEFT JOIN u2 USING (candidate))
    SELECT candidate, round(0.01*a + 0.5*b + 0.25*c + 0.5*d + {_OFF}, 6) AS penalty, round(0.02*native + {_OFF}, 6) AS bonus, concat_ws(',', CASE WHEN a > 0 THEN 'complexity_budget' END, CASE WHEN b > 0 THEN 'seat_duplicate' END, CASE WHEN c > 0 THEN 'feature_reuse' END,
    CASE WHEN d > 0 THEN 'chart_value_instability' END) AS reasons, a > 0 OR b > 0 OR c > 0 OR d > 0 AS triggered FROM r""")  # fmt: skip
def structure_guard(spark, sf_dir):
    k = F.col("p_partkey")
    family = F.when(k % 4 == 0, "trig").when(k % 4 == 1, "gate_interaction").when(k % 4 == 2, "interaction_basic").otherwise("other")
    terms = read(spark, sf_dir, "part").select(
        F.col("p_size").alias("candidate"), F.col("p_name").alias("key"), family.alias("family"), (k % 7).cast("double").alias("complexity"), F.array(k % 3, k % 5).alias("features"),
        F.when(k % 6 != 0, (k % 50) / 50.0).alias("stability"), F.lit(None).cast("double").alias("pole_safety"),
    )
    out = guards.structure_guard(terms)
    return out.select("candidate", r(F.col("penalty") + _OFF, name="penalty"), r(F.col("bonus") + _OFF, name="bonus"), F.concat_ws(",", "reasons").alias("reasons"), "triggered")


@query("a40_composite_score", """SELECT l_orderkey, l_linenumber, round((l_tax + 1000*greatest(l_discount - 0.09, 0)) + 1000*greatest(l_discount - 0.09, 0) - 0.04*abs(l_discount) + 7e-4*l_quantity - 0.02*l_tax - 0.01/(1 + l_linenumber) - 0.05*(l_discount*10 - 0.5)
    + 0.5*(l_linenumber % 2) + greatest(l_quantity - 49, 0) + greatest(l_quantity - 45, 0)/10 - 0.02*l_discount, 6) AS score FROM lineitem""")  # fmt: skip
def composite(spark, sf_dir):
    """All eleven parts, of columns that stand for the measures."""
    c = F.col
    over = lambda name, limit: F.greatest(c(name) - limit, F.lit(0.0))
    row = {
        "objective": c("l_tax"), "violation": over("l_discount", 0.09), "prior_corr": c("l_discount"), "complexity": c("l_quantity"), "alignment": c("l_tax"), "mean_seen": c("l_linenumber"),
        "accept_rate": c("l_discount") * 10, "duplicates": c("l_linenumber") % 2, "overfit": over("l_quantity", 49), "structure": over("l_quantity", 45) / 10, "bonus": 0.02 * c("l_discount"),
    }
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(guards.composite_score(row), name="score"))


@query("a25_prior_rates", f"WITH {LOG} SELECT event, count(*) AS seen, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS accept_rate, round(avg(value), 5) AS mean_score FROM log GROUP BY 1")
def prior_rates(spark, sf_dir):
    counts = catalog.counters(log(spark, sf_dir), ["event"], F.col("value") > 20, F.col("value"))
    return guards.prior_rates(counts).select("event", "seen", r("accept_rate"), r("mean_score", 5))


@query("a51_signals", f"WITH {_X} SELECT 'a' AS feature, round(abs(corr(a, t - a)), 6) AS signal FROM x UNION ALL SELECT 'b', round(abs(corr(b, t - a)), 6) FROM x UNION ALL SELECT 'c', round(abs(corr(c, t - a)), 6) FROM x")
def signals(spark, sf_dir):
    return guards.signals(_x(spark, sf_dir), F.col("t") - F.col("a"), ["a", "b", "c"]).select("feature", r("signal"))


@query("a55_masked_errors", """WITH m AS (SELECT l_suppkey % 10 AS u, l_partkey % 10 AS i, l_quantity / 10 AS r FROM lineitem), e AS (SELECT r - ((u + 1) * 0.1 + (i + 1) * 0.2) AS e FROM m)
    SELECT round(avg(e*e), 6) AS mse, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, count(*) AS observed FROM e""")  # fmt: skip
def masked_errors(spark, sf_dir):
    ratings = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("u"), (F.col("l_partkey") % 10).alias("i"), (F.col("l_quantity") / 10).alias("r"))
    users = spark.range(10).select(F.col("id").alias("u"), F.array((F.col("id") + 1) * 0.1, F.lit(1.0)).alias("f"))
    items = spark.range(10).select(F.col("id").alias("i"), F.array(F.lit(1.0), (F.col("id") + 1) * 0.2).alias("f"))
    out = guards.masked_errors(ratings, users, items, 2)
    return out.select(r("mse"), r("rmse"), r("mae"), "observed")


@query("pareto_front", "SELECT p_partkey, p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size <= p.p_size AND q.p_retailprice <= p.p_retailprice AND (q.p_size < p.p_size OR q.p_retailprice < p.p_retailprice OR q.p_partkey < p.p_partkey))")
def front(spark, sf_dir):
    return guards.pareto_front(read(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"]).select("p_partkey", "p_size", "p_retailprice")


@query("a41_walk_forward_summary", f"WITH {_FEATURES}, {_IC}, m AS (SELECT substr(d, 1, 4) AS fold, avg(ic) AS ic, count(*) AS n FROM ic GROUP BY 1) SELECT round(avg(ic), 6) AS mean_ic, round(stddev_pop(ic), 6) AS std_ic, count(*) AS folds FROM m")
def walk_forward_summary(spark, sf_dir):
    daily = panel.daily_rank_ic(_features(spark, sf_dir), "d", "mom_short", "target")
    folds = daily.groupBy(F.substring("d", 1, 4).alias("fold")).agg(F.avg("ic").alias("ic"))
    return folds.agg(r(F.avg("ic"), name="mean_ic"), r(F.stddev_pop("ic"), name="std_ic"), F.count("*").alias("folds"))


@query("t16_fold_metrics", f"""WITH {PREDICTIONS} SELECT l_orderkey % 5 AS fold, round(avg((y-yhat)*(y-yhat)), 6) AS mse, round(sqrt(avg((y-yhat)*(y-yhat))), 6) AS rmse, round(avg(abs(y-yhat)), 6) AS mae,
    round(1 - sum((y-yhat)*(y-yhat))/(var_pop(y)*count(y)), 6) AS r2 FROM pred GROUP BY 1""")  # fmt: skip
def fold_metrics(spark, sf_dir):
    out = metrics.regression(predictions(spark, sf_dir).withColumn("fold", F.col("l_orderkey") % 5), "y", "yhat", ["fold"])
    return out.select("fold", r("mse"), r("rmse"), r("mae"), r("r2"))


@query("t17_branch_metrics", f"""WITH {PREDICTIONS}, q AS (SELECT min(score) AS q0, quantile_cont(score, 0.5) AS q1, max(score) AS q2 FROM pred),
    z AS (SELECT 0 AS bucket, y, yhat FROM pred, q WHERE score BETWEEN q0 AND q1 UNION ALL SELECT 1, y, yhat FROM pred, q WHERE score BETWEEN q1 AND q2)
    SELECT bucket, round(sqrt(avg((y-yhat)*(y-yhat))), 6) AS rmse, round(avg(abs(y-yhat)), 6) AS mae FROM z GROUP BY 1""")  # fmt: skip
def branch_metrics(spark, sf_dir):
    rows = prep.quantile_buckets(predictions(spark, sf_dir), "score", [0.0, 0.5, 1.0])
    return metrics.regression(rows, "y", "yhat", ["bucket"]).select("bucket", r("rmse"), r("mae"))


@query("j6_neighbours", f"""WITH {_HELD}, p AS (SELECT DISTINCT x.key AS low, y.key AS high FROM h x JOIN h y ON x.v = y.v AND x.key < y.key)
    SELECT low AS key, 'up' AS side, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT high, 'down', count(*) FROM p GROUP BY 1""")  # fmt: skip
def neighbours(spark, sf_dir):
    pairs = catalog.relations(held(spark, sf_dir), "v", "v").where("source < target")
    side = lambda k, n: pairs.groupBy(F.col(k).alias("key")).agg(F.count("*").alias("n")).select("key", F.lit(n).alias("side"), "n")
    return side("source", "up").unionByName(side("target", "down"))


@query("j6_link_counts", """WITH g AS (SELECT DISTINCT o_custkey AS key, lower(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F'), q AS (SELECT DISTINCT o_custkey AS key, lower(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'O'), n AS (SELECT v, count(*) AS n FROM g GROUP BY 1),
    l AS (SELECT q.key AS key, sum(n.n - CASE WHEN g.key IS NULL THEN 0 ELSE 1 END) AS links FROM q JOIN n USING (v) LEFT JOIN g ON g.key = q.key AND g.v = q.v GROUP BY 1) SELECT k.key AS key, CAST(coalesce(links, 0) AS BIGINT) AS links FROM (SELECT DISTINCT o_custkey AS key FROM orders) k LEFT JOIN l ON l.key = k.key""")  # fmt: skip
def link_counts(spark, sf_dir):
    """Five values, each held by a large part of all customers."""
    of = lambda status: F.collect_set(F.when(F.col("o_orderstatus") == status, F.col("o_orderpriority")))
    e = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(of("F").alias("gives"), of("O").alias("needs"))
    return catalog.link_counts(e, "gives", "needs")


@query("j6_missing_companions", "SELECT DISTINCT l_partkey + 7 AS missing FROM lineitem WHERE l_partkey + 7 NOT IN (SELECT p_partkey FROM part)")
def missing_companions(spark, sf_dir):
    wanted = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 7).alias("missing"))
    return catalog.missing_companions(wanted, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("missing")), "missing")


_NET = """net AS (SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(p_partkey AS BIGINT) AS k, p_type AS kind FROM part), roles AS (SELECT key, kind, row_number() OVER (PARTITION BY kind ORDER BY key) AS r FROM net),
    peers AS (SELECT a.key AS key, b.key AS other, row_number() OVER (PARTITION BY a.key ORDER BY b.key) AS r FROM net a JOIN roles b ON a.kind = b.kind AND b.r <= 13 AND a.key <> b.key),
    arms AS (SELECT a.key AS key, 'context_up' AS arm, b.key AS other FROM net a JOIN net b ON b.k = a.k + 1 UNION ALL SELECT a.key, 'context_down', b.key FROM net a JOIN net b ON b.k = a.k - 1
    UNION ALL SELECT a.key, 'artifact_up', b.key FROM net a JOIN net b ON 2*a.k = 3*b.k AND a.k <> b.k UNION ALL SELECT a.key, 'artifact_down', b.key FROM net a JOIN net b ON 3*a.k = 2*b.k AND a.k <> b.k
    UNION ALL SELECT key, 'role_companion', other FROM peers WHERE r <= 12 UNION ALL SELECT a.key, 'companion', b.key FROM net a JOIN net b ON b.k = a.k + 7
    UNION ALL SELECT key, 'missing_companion', CAST(k + 7 AS VARCHAR) FROM net WHERE k + 7 NOT IN (SELECT k FROM net) UNION ALL SELECT a.key, 'linked_by', b.key FROM net a JOIN net b ON b.k = a.k - 7)"""


def _net(spark, sf_dir):
    """Entries that need the next one, give themselves, share artifacts with some, and name the seventh on."""
    text = lambda c, mark="": F.array(F.concat(F.lit(mark), c.cast("string")))
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.cast("string").alias("key"), F.col("p_type").alias("kind"), text(k + 1).alias("requires"), text(k).alias("provides"), text(2 * k, "A").alias("artifacts_in"), text(3 * k, "a").alias("artifacts_out"), text(k + 7).alias("companions")
    )


@query("j6_arms", f"WITH {_NET} SELECT * FROM arms")
def arms(spark, sf_dir):
    return catalog.neighbours(_net(spark, sf_dir))


@query("a7_usage_matrix", f"""WITH {_NET}, c AS (SELECT key, arm, count(*) AS n FROM arms GROUP BY 1, 2) SELECT net.key AS key, kind, {', '.join(f"CAST(coalesce(sum(CASE WHEN arm = '{a}' THEN n END), 0) AS BIGINT) AS {a}" for a in ("context_up", "context_down", "artifact_up", "artifact_down", "role_companion", "companion", "missing_companion", "linked_by"))}
    FROM net LEFT JOIN c ON c.key = net.key GROUP BY 1, 2""")  # fmt: skip
def usage_matrix(spark, sf_dir):
    net = _net(spark, sf_dir)
    return catalog.usage_matrix(net, catalog.neighbours(net))


@query("u4_tag_subset", f"WITH {ENTRIES} SELECT key FROM entries WHERE len(list_filter(['red', 'size7'], lambda w: NOT list_contains(tags, w))) = 0")
def tag_subset(spark, sf_dir):
    return entries(spark, sf_dir).where(catalog.has_all_tags(F.col("tags"), ["red", "size7"])).select("key")


@query("u7_recombine", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders")
def recombine(spark, sf_dir):
    out = prep.train_valid_split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.3)
    return prep.recombine(out).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))


@query("u8_scalar_index", f"WITH {ENTRIES} SELECT DISTINCT kind, lower(tag) AS value FROM (SELECT kind, unnest(tags) AS tag FROM entries)")
def scalar_index(spark, sf_dir):
    return catalog.scalar_index(entries(spark, sf_dir), "kind", "tags")


@query("u9_tagged_union", "SELECT 'customer' AS origin, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def tagged_union(spark, sf_dir):
    tables = {t: read(spark, sf_dir, t).select(F.col(c).alias("nation")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))}
    return catalog.tagged_union(tables).groupBy("origin", "nation").agg(F.count("*").alias("n"))


@query("x8_category_path", "SELECT n_nationkey, trim(r_name || '>' || n_name || '>', '>') AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def category_path(spark, sf_dir):
    n, g = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    joined = n.join(g, n["n_regionkey"] == g["r_regionkey"])
    return joined.select("n_nationkey", text.category_path(F.col("r_name"), F.col("n_name"), F.lit("")).alias("path"))


@query("x12_deep_links", "SELECT p_partkey, '/catalog?q=' || replace(replace(p_name, ' ', '+'), '#', '%23') || '&brand=' || replace(p_brand, '#', '%23') AS url FROM part")
def deep_links(spark, sf_dir):
    url = text.deep_link("/catalog", {"q": F.col("p_name"), "brand": F.col("p_brand")})
    return read(spark, sf_dir, "part").select("p_partkey", url.alias("url"))


@query("x13_link_parameters", "SELECT p_partkey, p_name AS q, p_brand AS brand, lower(p_type) AS kind FROM part")
def link_parameters(spark, sf_dir):
    """Links with two parameters and a field filter, parsed back."""
    url = text.deep_link("/catalog", {"q": F.col("p_name"), "brand": F.col("p_brand"), "field.Kind": F.lower("p_type"), "empty": F.lit("")})
    rows = read(spark, sf_dir, "part").select("p_partkey", text.query_parameters(url).alias("m"))
    return rows.select("p_partkey", F.col("m")["q"].alias("q"), F.col("m")["brand"].alias("brand"), text.field_filters(F.col("m"))["kind"].alias("kind"))


@query("x14_tag_lists", "SELECT p_partkey, lower(p_brand) || '|' || lower(p_type) AS tags FROM part")
def tag_lists(spark, sf_dir):
    tags = text.tag_list(F.concat(F.lit(" "), "p_brand", F.lit(",,"), F.upper("p_brand"), F.lit(" , "), "p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(tags, "|").alias("tags"))


@query("x18_target_codec", "SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(2, round_even(l_quantity / 20, 0))) AS INT) AS code FROM lineitem")
def target_codec(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", prep.target_code(F.col("l_quantity") / 20, 3).alias("code"))


@query("x19_json_payloads", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_payloads(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("x16_fingerprints", """SELECT p_partkey, sha256('{"p_name":"' || p_name || '","p_size":' || p_size || '}') AS fingerprint FROM part""")
def fingerprints(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.fingerprint(F.col("p_name"), F.col("p_size")).alias("fingerprint"))


@query("e4_drop_incomplete", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END, 6) AS ratio FROM lineitem WHERE l_tax <> 0")
def drop_incomplete(spark, sf_dir):
    ratio = F.try_divide("l_discount", "l_tax")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(ratio, name="ratio")).transform(prep.drop_incomplete)


@query("f15_binary_like", "SELECT bool_and(l_linenumber IN (0, 1)) AS linenumber, bool_and((l_orderkey % 2) IN (0, 1)) AS parity FROM lineitem")
def binary_like(spark, sf_dir):
    return prep.binary_like(read(spark, sf_dir, "lineitem"), {"linenumber": F.col("l_linenumber"), "parity": F.col("l_orderkey") % 2})


@query("w25_drawdown", """WITH s AS (SELECT o_custkey, o_orderkey, sum(ln(1 + (o_totalprice - 250000) / 1e7)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS le FROM orders)
    SELECT o_custkey, o_orderkey, round(exp(le - max(le) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) - 1, 6) AS drawdown FROM s""")  # fmt: skip
def drawdown(spark, sf_dir):
    rows = panel.drawdown(read(spark, sf_dir, "orders"), (F.col("o_totalprice") - 250000) / 1e7, "o_orderkey", ["o_custkey"])
    return rows.select("o_custkey", "o_orderkey", r("drawdown"))


@query("q32_capabilities", "WITH c AS (SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_custkey % 3 = 0) SELECT c_custkey, len(list_filter(['F', 'O', 'P'], lambda v: NOT list_contains(coalesce(h, []), v))) AS missing FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderstatus) AS h FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def capabilities(spark, sf_dir):
    have = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("h"))
    rows = read(spark, sf_dir, "customer").join(have, F.col("o_custkey") == F.col("c_custkey"), "left")
    need = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    gone = F.size(F.array_except(need, F.coalesce("h", F.array().cast("array<string>"))))
    return rows.select("c_custkey", gone.cast("long").alias("missing"))
