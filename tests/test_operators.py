"""Edge cases of single operators against NumPy or by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import expressions as X
from quern.functions import guards as G
from quern.operators import catalog, metrics, pool, prep, text, timeseries
from quern.plans import registry
from quern.sources import readers, sinks
from quern.streaming import events


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_safe_corr_without_variance(spark):
    df = frame(spark, [(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(G.safe_corr(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_protected_div(spark):
    df = frame(spark, [(1.0, 0.0), (1.0, -1e-9), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(G.protected_div(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1e6, -1e6, 2.0])


def test_running_over_ranges(spark):
    df = spark.range(1000).select("id", F.lit(1).cast("long").alias("one"))
    got = metrics.running(df.repartition(7), "id", {"n": "one"}).where("n != id + 1")
    assert got.count() == 0


def test_auc_matches_pairs(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 9, 80) / 8
    df = frame(spark, [(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    p, n = s[y == 1], s[y == 0]
    want = np.mean((p[:, None] > n) + 0.5 * (p[:, None] == n))
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(want)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()[0] == 0.5


def test_regression_r2_of_constant(spark):
    df = frame(spark, [(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression(df, "y", "p").first()["r2"] == 1.0
    assert metrics.regression(df, "y", "p", r2_mode="floor").first()["r2"] == 0.0


def test_zscore_constant_column(spark):
    out = prep.zscore(frame(spark, [(2.0,), (2.0,)], "a double"), ["a"])
    assert [r.a for r in out.collect()] == [0.0, 0.0]


def test_one_hot_unseen_and_null(spark):
    out = prep.one_hot(frame(spark, [("a",), ("z",), (None,)], "c string"), "c", ["a", "b"])
    assert [tuple(r) for r in out.collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_split_counts(spark):
    out = prep.train_valid_split(spark.range(11), "id", 0.25)
    assert out.where("split = 'valid'").count() == max(1, round(0.25 * 11))


@pytest.mark.parametrize("n,k", [(10, 3), (7, 7), (3, 5)])
def test_fold_sizes(spark, n, k):
    got = {r.fold: r["count"] for r in prep.k_fold(spark.range(n), "id", k).groupBy("fold").count().collect()}
    assert [got.get(i, 0) for i in range(k)] == [len(a) for a in np.array_split(np.arange(n), k)]


def test_valid_size_rounds_half_to_even():
    assert [timeseries.valid_size(0.25, n) for n in (2, 10, 14)] == [1, 2, 4]
    assert timeseries.valid_size(50, 10) == 9


def test_moving_average_edges(spark):
    y = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    df = frame(spark, [("s", i, v) for i, v in enumerate(y)], "s string, t int, y double")
    got = [r.m for r in df.select("t", timeseries.centered_average("y", "t", ["s"], 4).alias("m")).orderBy("t").collect()]
    assert got == pytest.approx(np.convolve(np.pad(y, 2, mode="edge"), np.ones(5) / 5, "valid"))


def test_lagged_rows(spark):
    df = frame(spark, [("s", i, float(i)) for i in range(10)], "s string, t int, y double")
    out = timeseries.lagged(df, "y", "t", ["s"], [1, 2], valid=2).orderBy("t").collect()
    assert (len(out), out[0].lag_1, out[0].lag_2, out[0].target) == (8, 1.0, 0.0, 2.0)
    assert [r.split for r in out].count("valid") == 2


def test_autoregressive_recovers_growth(spark):
    df = frame(spark, [("s", i, 2.0**i) for i in range(10)], "s string, t int, y double")
    got = [r.yhat for r in timeseries.autoregressive(df, "y", "t", ["s"], [1], 3).orderBy("step").collect()]
    assert got == pytest.approx([1024, 2048, 4096], rel=1e-6)


@pytest.mark.parametrize("op", ["square", "sin", "cos", "tanh", "exp"])
def test_derivative_by_differences(spark, op):
    e = X.bi("mul", X.un(op, X.feature(0)), X.feature(0))
    df = frame(spark, [(x / 4,) for x in range(-4, 5)], "x double")
    f = lambda h: X.to_column(e, [F.col("x") + h])
    slope = X.to_column(X.derivative(e, X.feature(0)), [F.col("x")])
    for got, lo, hi in df.select(slope, f(-1e-5), f(1e-5)).collect():
        assert got == pytest.approx((hi - lo) / 2e-5, abs=1e-5)


def test_expression_validation():
    with pytest.raises(ValueError):
        X.validate(X.feature(3), 2)
    assert X.complexity(X.bi("add", X.feature(0), X.const(1))) == 3


def test_family_quota_keeps_unlisted(spark):
    df = frame(spark, [("a", "f", 1.0, [0], 0.9), ("b", "f", 1.0, [0], 0.8), ("c", "g", 1.0, [0], 0.1)], pool.POOL)
    assert sorted(r.name for r in pool.family_quota(df, {"f": 1}).collect()) == ["a", "c"]
    assert pool.family_quota(df, {}).count() == 3


def test_search_filters(spark):
    schema = "key string, kind string, search_text string, tags array<string>, fields map<string,string>"
    df = frame(spark, [("k1", "A", "red 100% wool", ["X", "y"], {"size": "L"}), ("k2", "A", "red wool", ["x"], None)], schema)
    assert [r.key for r in catalog.search(df, "RED 100%").collect()] == ["k1"]
    assert [r.key for r in catalog.search(df, tags=("x",)).collect()] == ["k1", "k2"]
    assert [r.key for r in catalog.search(df, fields={"size": ["l", "m"]}).collect()] == ["k1"]


def test_encode_pads_and_cuts(spark):
    df = frame(spark, [(1, "cat sat"), (2, None), (3, "héllo zzz cat ran")], "id int, t string")
    vocab = text.vocabulary(frame(spark, [("cat sat",), ("dog sat",), ("cat ran",), ("dog ran",)], "t string"), "t")
    got = {r.id: r.ids for r in text.encode(df, "id", "t", vocab, 5, add_eos=True).collect()}
    assert got == {1: [4, 7, 3, 0, 0], 2: [3, 0, 0, 0, 0], 3: [1, 1, 4, 6, 3]}


def test_parse_budget(spark):
    df = frame(spark, [("poly:12, trig:x,bad,rad:-3",)], "s string")
    assert df.select(text.parse_budget(F.col("s"))).first()[0] == {"poly": 12, "rad": 0}


def test_sinks_and_returns(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = frame(spark, [(1, "a"), (2, "b")], "id int, p string")
    rows.write.parquet(path)
    assert sinks.append_new(frame(spark, [(2, "z"), (3, "c"), (3, "c")], "id int, p string"), path, "id") == 1
    assert spark.read.parquet(path).count() == 3
    part = str(tmp_path / "part")
    sinks.replace_partitions(rows, part, "p")
    sinks.replace_partitions(frame(spark, [(9, "a")], "id int, p string"), part, "p")
    assert sorted(r.id for r in spark.read.parquet(part).collect()) == [2, 9]
    wide = str(tmp_path / "wide")
    frame(spark, [("d1", 1.0, 2.0), ("d2", float("inf"), 1.0), ("d3", None, 1.0)], "date string, a double, b double").write.parquet(wide)
    assert readers.returns(spark, wide).count() == 1


def test_streams(spark, tmp_path, sf_dir):
    source = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = events.read(spark, source, schema)
    events.append(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(source).count()
    q = events.counters(events.read(spark, source, schema), ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("seen")
    q.trigger(availableNow=True).start().awaitTermination()
    want = events.counters(spark.read.parquet(source), ["event_type"], "value")
    assert {(r[0], r[1]) for r in spark.table("seen").collect()} == {(r[0], r[1]) for r in want.collect()}


@pytest.mark.parametrize("name,table", [("p2_select_columns", "lineitem"), ("p11_polynomial", "lineitem"), ("w25_drawdown", "orders")])
def test_whole_queries_keep_all_rows(spark, sf_dir, name, table):
    assert registry.queries()[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_whole_queries_keep_all_keys(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    count = lambda name, *keys: registry.queries()[name](spark, sf_dir).select(*keys).distinct().count()
    assert count("u2_first_wins", "l_orderkey", "l_partkey") == lines.select("l_orderkey", "l_partkey").distinct().count()
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    assert count("a26_consensus", "key") == parts.select("p_name").distinct().count()


def test_whole_relations_reach_all_customers(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    used = registry.queries()["j9_value_usage"](spark, sf_dir).agg(F.sum("producers")).first()[0]
    assert used == orders.select("o_custkey", F.lower("o_orderpriority"), "o_orderstatus", F.col("o_orderkey") % 50).distinct().count()
    for name, key in (("j5_relations", "source"), ("j6_neighbours", "key")):
        assert registry.queries()[name](spark, sf_dir).agg(F.max(key)).first()[0] > orders.agg(F.max("o_custkey")).first()[0] * 0.9


@pytest.mark.parametrize("kind", ["windowed", "sessions"])
def test_event_time_streams_agree_with_batches(spark, tmp_path, sf_dir, kind):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    # Watermarks need a timestamp with a zone.
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1).write.parquet(source)
    stream = events.read(spark, source, spark.read.parquet(source).schema)
    make = (lambda df: events.windowed(df, "ts", ["event_type"], "6 hours")) if kind == "windowed" else (lambda df: events.sessions(df.withWatermark("ts", "1 hour"), "ts", ["user_id"], "2 hours"))
    query = make(stream).writeStream.format("memory").queryName(kind).outputMode("complete" if kind == "windowed" else "append")
    query.option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    got, want = key(spark.table(kind)), key(make(spark.read.parquet(source)))
    # Append mode gives out what the watermark has passed: all but what is still open.
    assert got == want if kind == "windowed" else set(got) <= set(want) and len(got) > 0.9 * len(want)


def test_factor_csv_and_named_columns(spark, tmp_path):
    path = str(tmp_path / "f.csv")
    (tmp_path / "f.csv").write_text("y,a,b\n1,2,3\n2,4,\n3,6,9\n")
    out, found = readers.factor_csv(spark, path, {"g": ["a", "gone"], "h": ["b"]}, "y")
    assert found == {"g": ["a"], "h": ["b"]} and sorted(r.a for r in out.collect()) == [-1.0, 1.0]
    with pytest.raises(KeyError):
        readers.named_columns(out, ["y", "zz"])


def test_json_sink(spark, tmp_path):
    sinks.json(spark.range(3), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
