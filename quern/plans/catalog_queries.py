"""Queries over catalog entries, experiment logs, relations and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import catalog, metrics, text
from quern.plans.tables import ENTRIES, LOG, entries, log, r, read
from quern.sources import sinks
from quern.streaming import events as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("f5_search", f"""WITH {ENTRIES} SELECT key, kind FROM entries WHERE contains(search_text, 'red') AND contains(search_text, 'brand#1') AND list_contains(tags, 'widget') AND p_size BETWEEN 1 AND 20 AND (p_size = 7 OR p_size = 11 OR p_size = 3) ORDER BY kind, key LIMIT 100""")
def search(spark, sf_dir):
    return catalog.search(entries(spark, sf_dir), "Red brand#1", tags=("Widget",), fields={"size": ["7", "11", "3"]}, limit=100).select("key", "kind")


@query("f5_search_kind", f"WITH {ENTRIES} SELECT key, kind FROM entries WHERE kind = 'economy' AND contains(search_text, 'ring') ORDER BY kind, key LIMIT 50")
def search_kind(spark, sf_dir):
    return catalog.search(entries(spark, sf_dir), "ring", kind="ECONOMY", limit=50).select("key", "kind")


@query("a1_facets", f"""WITH {ENTRIES}, f AS (SELECT * FROM entries WHERE contains(search_text, 'small') ORDER BY kind, key LIMIT 150)
    SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest(tags) AS tag FROM f) GROUP BY 2""")  # fmt: skip
def facets(spark, sf_dir):
    return catalog.facets(catalog.search(entries(spark, sf_dir), "small", limit=150))


@query("a4_summary", f"WITH {ENTRIES} SELECT kind, count(*) AS n, count(DISTINCT p_brand) AS brands FROM entries GROUP BY 1")
def summary(spark, sf_dir):
    return catalog.summary(entries(spark, sf_dir), "kind", "p_brand").withColumnRenamed("distinct", "brands")


@query("a4_summary_payload", f"""WITH {ENTRIES}, k AS (SELECT kind, count(*) AS n FROM entries GROUP BY 1), t AS (SELECT DISTINCT unnest(tags) AS tag FROM entries)
    SELECT CAST((SELECT sum(n) FROM k) AS BIGINT) AS total, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM k) AS by_kind, (SELECT string_agg(tag, ',' ORDER BY tag) FROM t) AS tags""")  # fmt: skip
def summary_payload(spark, sf_dir):
    out = catalog.summary_payload(entries(spark, sf_dir))
    kinds = F.transform(F.map_entries("by_kind"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("total", F.array_join(kinds, ",").alias("by_kind"), F.array_join("tags", ",").alias("tags"))


@query("a5_schema_summary", f"WITH {ENTRIES} SELECT DISTINCT tag AS value FROM (SELECT unnest(tags) AS tag FROM entries)")
def schema_summary(spark, sf_dir):
    return catalog.distinct_values(entries(spark, sf_dir), "tags")


@query("a6_field_values", f"WITH {ENTRIES} SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM entries GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def field_values(spark, sf_dir):
    return catalog.field_values(entries(spark, sf_dir), F.col("fields")["size"], 20)


@query("f11_valid_entries", "SELECT count(*) AS n FROM part WHERE trim(p_name) <> '' AND p_partkey % 3 <> 0")
def valid_entries(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("key", F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.col("key")))
    return catalog.valid_entries(e).agg(F.count("*").alias("n"))


@query("u6_later_wins", "SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def later_wins(spark, sf_dir):
    return catalog.later_wins(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("u2_first_wins", "SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2")
def first_wins(spark, sf_dir):
    rows = catalog.first_wins(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "l_linenumber")
    return rows.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("first_line"))


_HELD = "h AS (SELECT DISTINCT o_custkey AS key, l_partkey || '-' || l_suppkey AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def held(spark, sf_dir):
    """Customers with the offers (part of a supplier) they bought: values that few customers hold however large the tables."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("v"))
    bought = read(spark, sf_dir, "orders").join(lines, "o_orderkey")
    return bought.groupBy(F.col("o_custkey").alias("key")).agg(F.collect_set("v").alias("v"))


@query("j5_relations", f"WITH {_HELD} SELECT o.key AS source, i.key AS target, count(*) AS shared FROM h o JOIN h i ON o.v = i.v AND o.key <> i.key GROUP BY 1, 2")
def relations(spark, sf_dir):
    return catalog.relations(held(spark, sf_dir), "v", "v")


@query("j9_value_usage", """WITH e AS (SELECT DISTINCT o_custkey AS key, lower(o_orderpriority || o_orderstatus || (o_orderkey % 50)) AS v FROM orders)
    SELECT v AS value, count(*) AS producers, count(*) AS consumers FROM e GROUP BY 1""")  # fmt: skip
def value_usage(spark, sf_dir):
    value = F.concat("o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 50).cast("string"))
    e = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_set(value).alias("v"))
    return catalog.value_usage(e, "v", "v")


@query("j7_companions", f"WITH {ENTRIES}, k AS (SELECT kind, key, row_number() OVER (PARTITION BY kind ORDER BY key) AS place FROM entries) SELECT * FROM k WHERE place <= 12")
def companions(spark, sf_dir):
    return catalog.companions(entries(spark, sf_dir), "kind", "key", 12)


@query("j1_category_paths", """SELECT c_custkey, coalesce(r_name, '') || '>' || n_name || '>' || c_mktsegment AS path FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    WHERE contains(lower(c_name), '77') OR contains(lower(n_name), '7')""")  # fmt: skip
def category_paths(spark, sf_dir):
    leaf = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    nation = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    out = catalog.category_paths(leaf, [(nation, "n_nationkey", "n_name"), (read(spark, sf_dir, "region"), "r_regionkey", "r_name")])
    out = out.where(F.contains(F.lower("c_name"), F.lit("77")) | F.contains(F.lower("n_name"), F.lit("7")))
    return out.select("c_custkey", F.concat_ws(">", "path", "c_mktsegment").alias("path"))


@query("j3_bigram_scores", "WITH s AS (SELECT p_partkey, CAST(contains(p_name, 're') AS INT) + CAST(contains(p_name, 'ed') AS INT) + CAST(contains(p_name, 'd ') AS INT) + CAST(contains(p_name, ' w') AS INT) AS score FROM part) SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 40")
def bigram_scores(spark, sf_dir):
    return catalog.bigram_scores(read(spark, sf_dir, "part"), F.col("p_name"), "red w", 40, "p_partkey").select("p_partkey", "score")


@query("f9_experiments", f"WITH {LOG} SELECT seq, run_name, event, step FROM log WHERE event = 'click' AND step >= 10 AND step <= 60 AND contains(payload, '7') ORDER BY seq LIMIT 200")
def experiments(spark, sf_dir):
    return catalog.experiments(log(spark, sf_dir), event="click", min_step=10, max_step=60, payload="7").select("seq", "run_name", "event", "step")


@query("a3_summarize", f"""WITH {LOG} SELECT 'total' AS facet, NULL AS value, count(*) AS n FROM log UNION ALL SELECT 'event', event, count(*) FROM log GROUP BY 2
    UNION ALL SELECT 'run', CAST(run_name AS VARCHAR), count(*) FROM log GROUP BY 2""")  # fmt: skip
def summarize(spark, sf_dir):
    return catalog.summarize(log(spark, sf_dir))


@query("a21_counters", f"WITH {LOG} SELECT run_name, event, count(*) AS seen, CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS success, CAST(sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) AS BIGINT) AS failure, round(sum(value), 4) AS score_sum FROM log GROUP BY 1, 2")
def counters(spark, sf_dir):
    out = catalog.counters(log(spark, sf_dir), ["run_name", "event"], F.col("value") > 20, F.col("value"))
    return out.select("run_name", "event", "seen", "success", "failure", r("score_sum", 4))


@query("a24_prior", f"""WITH {LOG}, c AS (SELECT run_name, count(*) AS seen, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS rate FROM log WHERE event = 'error' GROUP BY 1)
    SELECT c_custkey AS run_name, round(coalesce(rate, 0.5), 6) AS accept_rate, coalesce(seen, 0) AS seen FROM customer LEFT JOIN c ON c_custkey = run_name""")  # fmt: skip
def prior(spark, sf_dir):
    counts = catalog.counters(log(spark, sf_dir).where("event = 'error'"), ["run_name"], F.col("value") > 20, F.col("value"))
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_name"))
    return catalog.prior(counts, keys, ["run_name"]).select("run_name", r("accept_rate"), "seen")


@query("k1_dedupe_append", f"WITH {LOG} SELECT seq FROM log WHERE seq % 3 <> 0")
def append_new(spark, sf_dir):
    rows = log(spark, sf_dir)
    return sinks.fresh_rows(rows, rows.where("seq % 3 = 0"), "seq").select("seq")


@query("st_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windows(spark, sf_dir):
    return streams.windowed(read(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour")


@query("st_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def sessions(spark, sf_dir):
    return streams.sessions(read(spark, sf_dir, "events"), "ts", ["user_id"], "2 hours")


_TOKENS = "tk AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]')) AS token FROM documents)"


@query("x3_top_tokens", f"WITH {_TOKENS}, c AS (SELECT lang, token, count(*) AS n FROM tk GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS place FROM c) SELECT * FROM k WHERE place <= 20")
def top_tokens(spark, sf_dir):
    return text.top_tokens(read(spark, sf_dir, "documents"), "lang", "text", 20)


@query("a48_vocabulary", f"WITH {_TOKENS}, c AS (SELECT token, count(*) AS n FROM tk GROUP BY 1 HAVING count(*) >= 3) SELECT token, n, row_number() OVER (ORDER BY token) + 3 AS id FROM c")
def vocabulary(spark, sf_dir):
    return text.vocabulary(read(spark, sf_dir, "documents"), "text", 3)


_ITEMS = f"""{_TOKENS.replace('FROM documents', 'FROM benchmark').replace('doc_id, lang', 'item_id')}, c AS (SELECT token, row_number() OVER (ORDER BY token) + 3 AS id FROM (SELECT token FROM tk GROUP BY 1 HAVING count(*) >= 2)),
    s AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]') AS t FROM benchmark), e AS (SELECT item_id, generate_subscripts(t, 1) AS p, unnest(t) AS token FROM s),
    g AS (SELECT item_id, list(coalesce(id, 1) ORDER BY p) AS ids FROM e LEFT JOIN c USING (token) GROUP BY 1)"""
_LONG = 128


@query("x4_encode", f"WITH {_ITEMS} SELECT item_id, array_to_string(list_resize(list_concat([2], ids, [3])[1:{_LONG}], {_LONG}, 0), ' ') AS ids FROM g")
def encode(spark, sf_dir):
    """Room for every item whole: the longest has fewer than 100 tokens."""
    items = read(spark, sf_dir, "benchmark")
    out = text.encode(items, "item_id", "text", text.vocabulary(items, "text", 2), _LONG, add_bos=True, add_eos=True)
    return out.select("item_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("x5_token_dataset", f"""WITH {_ITEMS}, o AS (SELECT item_id, row_number() OVER (ORDER BY ((item_id * 2654435761 + 1) % 4294967296), item_id) - 1 AS pos, count(*) OVER () AS n FROM benchmark)
    SELECT item_id, array_to_string(list_resize(list_concat(ids, [3])[1:{_LONG}], {_LONG}, 0), ' ') AS ids, CAST(least(len(ids) + 1, {_LONG}) AS BIGINT) AS used, CAST(item_id % 2 AS DOUBLE) AS label, CASE WHEN pos < greatest(1, round_even(0.25*n, 0)) THEN 'valid' ELSE 'train' END AS split FROM g JOIN o USING (item_id)""")  # fmt: skip
def token_dataset(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").withColumn("label", F.col("item_id") % 2)
    out = text.token_dataset(items, "item_id", "text", "label", _LONG, 0.25, 1, 2)
    used = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, m: a + m)
    return out.select("item_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), used.alias("used"), "label", "split")


@query("t8_keyword_search", "WITH s AS (SELECT doc_id, CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'que ') AS INT) + CAST(contains(lower(text), 'ung') AS INT) AS score FROM documents) SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def keyword_search(spark, sf_dir):
    score = text.keyword_score(F.col("text"), ["tion", "que ", "ung"])
    return read(spark, sf_dir, "documents").select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


_SNAKE = r"trim(lower(regexp_replace(regexp_replace(regexp_replace({0}, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^a-zA-Z0-9]+', '_', 'g')), '_')"


@query("x7_synonym_search", "WITH s AS (SELECT doc_id, CAST(contains(lower(text), 'water') AS INT) + CAST(contains(lower(text), 'eau') AS INT) + CAST(contains(lower(text), 'der ') AS INT) AS score FROM documents) SELECT doc_id, score FROM s WHERE score > 0")
def synonym_search(spark, sf_dir):
    score = text.keyword_score(F.col("text"), ["Water", "der "], {"Water": ["eau"]})
    return read(spark, sf_dir, "documents").select("doc_id", score.alias("score")).where("score > 0")


@query("x10_snake_case", f"SELECT c_custkey, {_SNAKE.format("c_name || ' / ' || c_mktsegment || 'FooBar.'")} AS name, CASE WHEN c_custkey % 2 = 0 THEN 'component' ELSE {_SNAKE.format('c_mktsegment')} END AS other FROM customer")
def snake_case(spark, sf_dir):
    mixed = F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("FooBar."))
    other = F.when(F.col("c_custkey") % 2 == 0, F.lit("--")).otherwise(F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.camel_to_snake(mixed).alias("name"), text.camel_to_snake(other).alias("other"))


@query("x15_hashes", "SELECT p_partkey, sha1(p_name) AS name_sha1, sha256(p_type) AS type_sha256 FROM part")
def hashes(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.sha1("p_name").alias("name_sha1"), F.sha2("p_type", 256).alias("type_sha256"))


@query("a58_triplets", """WITH c AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM c GROUP BY 1, 2),
    d AS (SELECT c.vec_id, c.label, m.label AS other, sqrt(sum((v - m) * (v - m))) AS dist FROM c JOIN m USING (i) GROUP BY 1, 2, 3), b AS (SELECT vec_id, label, arg_min(other, dist) AS near FROM d GROUP BY 1, 2)
    SELECT label, count(*) AS n, round(avg(CASE WHEN near = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM b GROUP BY 1""")  # fmt: skip
def nearest_centres(spark, sf_dir):
    """Share of vectors nearest to their own label's centre. Labels are few: their centres are one broadcast row."""
    e = read(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    if centres.count() > 10_000:
        raise ValueError("more than 10000 labels")
    centres = centres.agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("centres"))

    def far(c):
        return F.aggregate(F.zip_with("v", c, lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)

    near = F.array_min(F.transform("centres", lambda s: F.struct(far(s["c"]).alias("d"), s["label"].alias("label"))))["label"]
    rows = e.crossJoin(F.broadcast(centres)).select("label", near.alias("near"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), r(F.avg((F.col("near") == F.col("label")).cast("double")), name="accuracy"))


@query("a58_triplet_retrieval", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), t AS (SELECT list_distance(a.v, p.v) AS p, list_distance(a.v, n.v) AS n, len(a.v) AS k FROM v a JOIN v p ON p.vec_id = a.vec_id + 1 JOIN v n ON n.vec_id = a.vec_id + 2)
    SELECT round(avg(CASE WHEN p*p/k < n*n/k THEN 1.0 ELSE 0.0 END), 6) AS retrieval_accuracy, round(avg(p*p/k), 6) AS positive_distance, round(avg(n*n/k), 6) AS negative_distance, round(avg(greatest(p*p/k - n*n/k + 1, 0)), 6) AS triplet_loss FROM t""")  # fmt: skip
def triplet_retrieval(spark, sf_dir):
    """Each vector, with the next one as its positive and the one after that as its negative."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("anchor"))
    other = lambda step, name: v.select((F.col("vec_id") - step).alias("vec_id"), F.col("anchor").alias(name))
    rows = v.join(other(1, "positive"), "vec_id").join(other(2, "negative"), "vec_id")
    out = metrics.triplets(rows, "anchor", "positive", "negative")
    return out.select(*(r(c) for c in out.columns))


@query("a58_preferences", """WITH p AS (SELECT l_discount - l_tax AS policy, l_quantity/100 - 0.25 AS ref FROM lineitem), z AS (SELECT policy, ref, 2.0*(policy - ref) AS x FROM p)
    SELECT round(avg(ln(1 + exp(-x))), 6) AS dpo_loss, round(avg(CASE WHEN policy > ref THEN 1.0 ELSE 0.0 END), 4) AS preference_accuracy, round(avg(policy), 6) AS policy_margin, round(avg(ref), 6) AS reference_margin, round(exp(least(avg(abs(x)), 50)), 6) AS perplexity FROM z""")  # fmt: skip
def preferences(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumns({"rc": F.col("l_quantity") / 100, "rr": F.lit(0.25)})
    out = metrics.preferences(rows, "l_discount", "l_tax", "rc", "rr", 2.0)
    gap = rows.agg(metrics.perplexity(F.avg(F.abs(2.0 * (F.col("l_discount") - F.col("l_tax") - (F.col("rc") - F.col("rr")))))).alias("perplexity"))
    return out.crossJoin(F.broadcast(gap)).select(r("dpo_loss"), r("preference_accuracy", 4), r("policy_margin"), r("reference_margin"), r("perplexity"))


@query("s5_conversations", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def conversations(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))
