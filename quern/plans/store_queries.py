"""Queries of derivatives, nested payloads, the table store, text indexes, near vectors and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import derivatives as D
from quern.functions import expressions as X
from quern.operators import activation, near_vectors, payloads, relations, sampling
from quern.operators.text_index import TextIndex
from quern.plans.tables import ENTRIES, entries, r, read
from quern.runtime import shared_path
from quern.sources import bundles
from quern.sources.store import TableStore
from quern.streaming import counters

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Exponential of 0.9 times the quantity, which the clip cuts, over the discount, which is often 0, plus a root.
_E = X.bi("add", X.bi("div", X.un("exp", X.bi("mul", {"type": "param", "name": "w", "init": 0.9}, X.feature(0))), X.feature(1)), X.un("sqrt", X.bi("sub", X.feature(2), {"type": "param", "name": "c", "init": 0.04})))
_DUAL = """x AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem),
    g AS (SELECT *, exp(greatest(least(0.9*a, 30), -30)) AS e, CASE WHEN 0.9*a <= 30 THEN 1.0 ELSE 0.0 END AS inside, CASE WHEN abs(b) < 1e-6 THEN 1e-6 ELSE b END AS u, c - 0.04 AS z FROM x)"""


@query("m8_derivative_values", f"""WITH {_DUAL} SELECT l_orderkey, l_linenumber, round((e/u + sqrt(abs(z) + 1e-6)) / 1e12, 6) AS value, round(inside*0.9*e/u / 1e12, 6) AS d_a, round(-e/(u*u) / 1e18, 6) AS d_b, round(sign(z)/(2*sqrt(abs(z) + 1e-6)), 6) AS d_c FROM g""")
def derivative_values(spark, sf_dir):
    """Slopes by the features, with the guards of clip, division and root."""
    d = D.dual(_E, [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")], [X.feature(i) for i in range(3)])
    out = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d.alias("d"))
    s = F.col("d.slopes")
    return out.select("l_orderkey", "l_linenumber", r(F.col("d.value") / 1e12, name="value"), r(s[0] / 1e12, name="d_a"), r(s[1] / 1e18, name="d_b"), r(s[2], name="d_c"))


@query("m9_jacobian", f"WITH {_DUAL} SELECT l_orderkey, l_linenumber, round(inside*a*e/u / 1e12, 6) AS d_w, round(-sign(z)/(2*sqrt(abs(z) + 1e-6)), 6) AS d_c FROM g")
def parameter_jacobian(spark, sf_dir):
    names, d = D.jacobian(_E, [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")])
    out = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d.alias("d"))
    at = {n: F.col("d.slopes")[i] for i, n in enumerate(names)}
    return out.select("l_orderkey", "l_linenumber", r(at["w"] / 1e12, name="d_w"), r(at["c"], name="d_c"))


_PAYLOAD = """'{"a": {"list": [" ' || event_type || ' ", [{"deep": ' || props || '}], null, true]}, "empty": {}, "user": ' || user_id || ', "void": null}'"""


@query("x11_payload_strings", """SELECT event_id, 'a|list|' || event_type || '|deep|k|' || json_extract_string(props, '$.k') || '|true|empty|user|' || user_id || '|void' AS strings, CAST(11 AS BIGINT) AS n FROM events""")
def payload_strings(spark, sf_dir):
    """Keys and scalars of nested payloads made of the events and their own ones."""
    rows = read(spark, sf_dir, "events").select("event_id", F.expr(_PAYLOAD).alias("payload"))
    out = payloads.flattened(rows, "event_id", "payload")
    return out.select("event_id", F.array_join("strings", "|").alias("strings"), F.size("strings").cast("long").alias("n"))


@query("q23_stored_relations", f"WITH {ENTRIES} SELECT p_brand AS key, count(*) AS parts, max(p_size) AS largest, false AS more FROM entries GROUP BY 1")
def stored_relations(spark, sf_dir):
    """Summaries stored as JSON by brand, read back at paths."""
    held = entries(spark, sf_dir).groupBy(F.col("p_brand").alias("key")).agg(F.to_json(F.struct(F.struct(F.count("*").alias("parts"), F.array(F.max("p_size")).alias("sizes")).alias("summary"))).alias("json"))
    read_ = lambda path, kind, name: payloads.read_path("json", path, kind).alias(name)
    return held.select("key", read_("$.summary.parts", "long", "parts"), read_("$.summary.sizes[0]", "int", "largest"), payloads.read_path("json", "$.summary.sizes[1]", "long").isNotNull().alias("more"))


@query("k1_replace_profile", f"""WITH {ENTRIES} SELECT 'large' AS profile, key, p_size AS size FROM entries WHERE p_size > 25 UNION ALL SELECT 'brands', p_brand, CAST(count(*) AS INT) FROM entries GROUP BY 2""")
def replace_profile(spark, sf_dir):
    """Two profiles of a store; one is replaced as a whole."""
    store = TableStore(spark, shared_path(spark, "store"))
    parts = entries(spark, sf_dir).select("key", F.col("p_size").alias("size"), "p_brand")
    store.replace("large", parts.select("key", "size"))
    store.replace("brands", parts.groupBy(F.col("p_brand").alias("key")).agg(F.count("*").cast("int").alias("size")))
    store.replace("large", parts.where("size > 25").select("key", "size"))
    out = None
    for name in store.profiles():
        rows = store.read(name).select(F.lit(name).alias("profile"), "key", "size")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("k2_upsert", """WITH o AS (SELECT o_custkey AS k, o_orderdate AS d, o_orderkey AS i FROM orders), a AS (SELECT k, count(*) AS n, max(i) AS last FROM o WHERE d < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT k, count(*) AS n, max(i) AS last FROM o WHERE d >= TIMESTAMP '1998-01-01' GROUP BY 1)
    SELECT k AS custkey, coalesce(b.n, a.n) AS n, coalesce(b.last, a.last) AS last FROM a FULL JOIN b USING (k)""")  # fmt: skip
def upsert(spark, sf_dir):
    """Customers' counts of early orders, updated by those of later ones."""
    store, orders = TableStore(spark, shared_path(spark, "store")), read(spark, sf_dir, "orders")
    counts = lambda rows: rows.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    store.upsert("customers", counts(orders.where(early)), ["custkey"])
    store.upsert("customers", counts(orders.where(~early)), ["custkey"])
    return store.read("customers")


@query("a23_outcome_counters", """WITH e AS (SELECT event_type AS expr, user_id % 10 AS ns, event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value > 50 END AS ok, value FROM events)
    SELECT ns, expr, count(*) AS seen, count(CASE WHEN ok THEN 1 END) AS success, count(CASE WHEN NOT ok THEN 1 END) AS failure, round(sum(CASE WHEN ok IS NULL THEN 0 ELSE value / 100 END), 4) AS total_delta_score, round(sum(CASE WHEN ok IS NULL THEN 0 ELSE value END), 4) AS total_selected_score FROM e GROUP BY 1, 2""")  # fmt: skip
def outcome_counters(spark, sf_dir):
    """Touches and outcomes of the events, each of which comes twice and counts once."""
    e = read(spark, sf_dir, "events")
    log = e.unionByName(e).select(F.col("event_type").alias("expr"), (F.col("user_id") % 10).alias("ns"), "event_id", "value")
    ok = F.when(F.col("expr") != "view", F.col("value") > 50)
    out = counters.totals(counters.outcomes(log, ["ns", "expr"], "event_id", ok, F.col("value") / 100, F.col("value")), ["ns", "expr"])
    return out.select("ns", "expr", "seen", "success", "failure", r("total_delta_score", 4), r("total_selected_score", 4))


@query("f5_index_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'que ')")
def index_search(spark, sf_dir):
    """Documents that hold two strings, by posting lists."""
    docs = read(spark, sf_dir, "documents")
    index = TextIndex(spark).build(docs, "doc_id", "text")
    return index.search(docs, "doc_id", "text", ["TION", "que "]).select("doc_id", "lang")


@query("t8_index_top", "WITH s AS (SELECT doc_id, CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'que ') AS INT) + CAST(contains(lower(text), 'ung') AS INT) AS score FROM documents) SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def index_top(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return TextIndex(spark).build(docs, "doc_id", "text").top(docs, "doc_id", "text", ["tion", "que ", "ung"], 50)


_RADIUS = 1.15


@query("j13_near_vectors", f"""WITH v AS MATERIALIZED (SELECT min(vec_id) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL GROUP BY 2)
    SELECT p.id AS a, q.id AS b, round(list_distance(p.v, q.v), 6) AS distance FROM v p JOIN v q ON p.id < q.id AND list_distance(p.v, q.v) <= {_RADIUS}""")
def near_vector_pairs(spark, sf_dir):
    found, _ = near_vectors.near_pairs(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", _RADIUS)
    return found.select("a", "b", r("distance"))


_U = "((CAST('0x' || substr(md5('11|' || draw || '|' || c_nationkey || '|' || c_custkey), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query("q46_sampling", f"""WITH k AS (SELECT c_nationkey, c_custkey, c_acctbal / 2000 AS l, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal / 2000 DESC, c_custkey) AS r FROM customer),
    s AS (SELECT c_nationkey, c_custkey, draw, l / 0.7 - ln(-ln({_U})) AS s FROM k, range(3) q(draw) WHERE r <= 8)
    SELECT c_nationkey, CAST(draw AS INT) AS draw, arg_max(c_custkey, s) AS token FROM s GROUP BY 1, 2""")
def token_sampling(spark, sf_dir):
    """Three draws for each nation among its eight customers with the largest balances."""
    rows = read(spark, sf_dir, "customer").withColumn("l", F.col("c_acctbal") / 2000)
    return sampling.next_tokens(rows, ["c_nationkey"], "c_custkey", "l", 0.7, 8, 11, 3)


# Contexts of a part: words of its name, once as they are and once in capitals; its type is an artifact or a resource for some.
_CONTRACT = """e AS (SELECT p_partkey, lower(p_brand) AS kind, p_name || ' ' || upper(p_name) AS names, CASE p_size % 4 WHEN 0 THEN 'model_artifact.' WHEN 1 THEN 'Resource.' ELSE 'data.' END || lower(p_type) AS made FROM part)"""


def _contracts(spark, sf_dir):
    made = F.concat(F.when(F.col("p_size") % 4 == 0, "model_artifact.").when(F.col("p_size") % 4 == 1, "Resource.").otherwise("data."), F.lower("p_type"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.lower("p_brand").alias("kind"), F.split(F.concat_ws(" ", "p_name", F.upper("p_name")), " ").alias("context_requires"),
        F.array(made, F.concat(F.lit(" "), F.upper(made))).alias("context_provides"), F.array(F.lit(" "), F.lit("fit")).alias("phase_in"), F.array(F.lit("FIT"), F.lit("step")).alias("meta_phase_in"),
    )


@query("q19_relation_fields", f"""WITH {_CONTRACT}, w AS (SELECT *, list_transform(string_split(names, ' '), lambda x: x) AS ws FROM e),
    u AS (SELECT *, list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i) AS req FROM w)
    SELECT p_partkey, array_to_string(req, ',') AS context_requires, made AS context_provides, CASE WHEN made LIKE 'model_artifact.%' THEN made ELSE '' END AS artifact_provides, 'fit,step' AS phase_in,
    CASE WHEN made LIKE 'Resource.%' THEN made ELSE '' END AS resource_refs, lower(array_to_string(list_concat(list_concat(req, [made]), list_filter([CASE WHEN made LIKE 'model_artifact.%' THEN made END, 'fit', 'step', CASE WHEN made LIKE 'Resource.%' THEN made END], lambda x: x IS NOT NULL)), ' ')) AS search_text FROM u""")
def relation_fields(spark, sf_dir):
    """Requirements and products of the parts, with what is an artifact or resource among them, and the text that searches look at."""
    out = relations.relation_fields(_contracts(spark, sf_dir))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("p_partkey", *map(joined, ("context_requires", "context_provides", "artifact_provides", "phase_in", "resource_refs")), relations.field_text().alias("search_text"))


@query("q20_usage_profile", f"""WITH {_CONTRACT}, h AS (SELECT lower(p_brand) AS kind, min(p_type) AS hint FROM part GROUP BY 1)
    SELECT p_partkey, CASE WHEN made LIKE 'data.%' THEN 'data_view' WHEN made LIKE 'Resource.%' THEN 'ResourceContext' ELSE 'artifact' END || CASE WHEN kind IN ('brand#1', 'brand#2') THEN ',planner' ELSE '' END AS required_roles, hint AS use_when FROM e JOIN h USING (kind)""")
def usage_profile(spark, sf_dir):
    """Roles and uses: from the parts' fields, and from hints for their kinds."""
    parts = relations.relation_fields(_contracts(spark, sf_dir).drop("context_requires"))
    role = F.when(F.col("kind").isin("brand#1", "brand#2"), F.array(F.lit("planner"))).otherwise(F.array().cast("array<string>"))
    hints = read(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("kind")).agg(F.min("p_type").alias("t"))
    none = F.array().cast("array<string>")
    hints = hints.select("kind", F.lit(None).cast("long").alias("p_partkey"), F.array("t").alias("use_when"), none.alias("minimal_wiring"), role.alias("required_roles"), none.alias("config_keys"))
    out = relations.usage_profile(parts, hints, key="p_partkey")
    return out.select("p_partkey", F.array_join("required_roles", ",").alias("required_roles"), F.array_join("use_when", ",").alias("use_when"))


@query("m69_activation_plan", """WITH s AS (SELECT max(abs(l_discount - 0.05)) * 10 AS n, max(l_tax) * 10 AS i, max(l_quantity) / 100 AS t FROM lineitem),
    f AS (SELECT unnest([{'f': 'poly', 's': n}, {'f': 'bounded', 's': 0.9*n}, {'f': 'saturation', 's': 0.82*n + 0.18*t}, {'f': 'radial', 's': 0.72*n + 0.28*t}, {'f': 'safe_log', 's': 0.85*n + 0.15*t}]) AS u FROM s),
    p AS (SELECT unnest([{'f': 'interaction_basic', 's': i}, {'f': 'interaction_poly', 's': 0.85*i + 0.15*n}, {'f': 'interaction_compose', 's': 0.7*i + 0.3*n}, {'f': 'interaction_saturation', 's': 0.72*i + 0.18*n + 0.1*t}, {'f': 'interaction_radial', 's': 0.62*i + 0.38*t}, {'f': 'interaction_rational', 's': 0.68*i + 0.22*n + 0.1*t}, {'f': 'linear_combo', 's': 0.5*i + 0.1*n}]) AS u FROM s),
    r AS (SELECT u.f AS family, 'unary' AS role, u.s AS score, row_number() OVER (ORDER BY u.s DESC, u.f) AS place FROM f UNION ALL SELECT u.f, 'pair', u.s, row_number() OVER (ORDER BY u.s DESC, u.f) FROM p)
    SELECT family, role, round(score, 6) AS score, place FROM r WHERE place <= 2""")
def activation_plan(spark, sf_dir):
    """The two best families of each kind, from strengths of the items' columns; only logarithms are allowed besides the plain ones."""
    x = read(spark, sf_dir, "lineitem")
    one = lambda kind, value: x.select(F.lit(kind).alias("kind"), value.alias("value"))
    signals = one("nonlinear", (F.col("l_discount") - 0.05) * 10).unionByName(one("interaction", F.col("l_tax") * 10)).unionByName(one("threshold", F.col("l_quantity") / 100))
    return activation.plan(signals, ("safe_log",), unary_top=2, pair_top=2).select("family", "role", r("score"), F.col("place").cast("long").alias("place"))


@query("k5_artifact_bundle", """SELECT 'coefficients' AS table_name, l_returnflag AS name, round(regr_slope(l_extendedprice / 1000, l_quantity), 4) AS value, count(*) OVER () AS rows_kept FROM lineitem GROUP BY 2""")
def artifact_bundle(spark, sf_dir):
    """Coefficients by flag and their number, saved as a bundle and loaded again."""
    from quern.operators import timeseries

    x = read(spark, sf_dir, "lineitem").withColumn("t", F.col("l_extendedprice") / 1000)
    fitted = timeseries.fit_linear(x, ["l_quantity"], "t", ["l_returnflag"])
    path = shared_path(spark, "bundle")
    bundles.save(spark, path, {"coefficients": fitted}, {"target": "price", "rows_kept": fitted.count()})
    tables, facts = bundles.load(spark, path)
    return tables["coefficients"].select(F.lit("coefficients").alias("table_name"), F.col("l_returnflag").alias("name"), r(F.col("coefficients")[1], 4, "value"), F.lit(facts["rows_kept"]).cast("long").alias("rows_kept"))
