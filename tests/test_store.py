"""Derivative values, payloads, upserts, the store, text indexes, near vectors, pruning and draws by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import derivatives as D
from quern.functions import expressions as X
from quern.operators import catalog, near_vectors, payloads, pool, sampling
from quern.operators.text_index import TextIndex
from quern.sources.store import Conflict, TableStore
from quern.streaming import counters, events


def random_expression(rng, depth):
    if depth == 0 or rng.random() < 0.15:
        return rng.choice([X.feature(0), X.feature(1), X.const(1.5), {"type": "param", "name": "p", "init": 0.7}, {"type": "param", "name": "q", "init": -0.4, "trainable": False}])
    if rng.random() < 0.5:
        return X.un(rng.choice(list(D._UNARY)), random_expression(rng, depth - 1))
    return X.bi(rng.choice(["add", "sub", "mul", "div"]), random_expression(rng, depth - 1), random_expression(rng, depth - 1))


@pytest.mark.parametrize("seed", range(6))
def test_slopes_equal_differences(spark, seed):
    rng = random.Random(seed)
    e, h = random_expression(rng, 3), 1e-6
    points = [(rng.uniform(0.3, 2), rng.uniform(-2, -0.3)) for _ in range(12)]
    df = spark.createDataFrame(points, "a double, b double")
    wrt = [X.feature(0), X.feature(1), {"type": "param", "name": "p"}]
    value = lambda a, b, p: X.to_column(e, [a, b], {"p": p})
    a, b = F.col("a"), F.col("b")
    steps = [(value(a + h, b, 0.7), value(a - h, b, 0.7)), (value(a, b + h, 0.7), value(a, b - h, 0.7)), (value(a, b, 0.7 + h), value(a, b, 0.7 - h))]
    rows = df.select(D.dual(e, [a, b], wrt).alias("d"), value(a, b, 0.7).alias("v"), F.array(*((u - w) / (2 * h) for u, w in steps)).alias("n")).collect()
    for r in rows:
        assert r.d.value == pytest.approx(r.v, rel=1e-12)
        if abs(r.v) < 1e4:
            assert r.d.slopes == pytest.approx(r.n, rel=2e-3, abs=1e-3)


def test_guards_of_slopes(spark):
    x = spark.createDataFrame([(40.0, 0.0), (1.0, -1e-9), (None, 2.0)], "a double, b double")
    e = X.bi("div", X.un("exp", X.feature(0)), X.feature(1))
    got = [r.d for r in x.select(D.dual(e, [F.col("a"), F.col("b")], [X.feature(0), X.feature(1)]).alias("d")).collect()]
    assert got[0].slopes[0] == 0 and got[0].value == pytest.approx(math.exp(30) / 1e-6)
    assert got[1].slopes == pytest.approx([math.e / -1e-6, -math.e / 1e-12]) and got[2].value is None
    names, d = D.jacobian(X.bi("mul", {"type": "param", "name": "q", "trainable": False}, X.bi("add", {"type": "param", "name": "z"}, {"type": "param", "name": "b"})), [])
    assert names == ["z", "b"] and x.select(d.alias("d")).first().d.slopes == [1.0, 1.0]
    grads = D.parameter_gradient(X.bi("mul", {"type": "param", "name": "w", "init": 2.0}, X.feature(0)), [F.col("b")], F.lit(1.0), l2=0.5)
    b = [0.0, -1e-9, 2.0]
    assert x.agg(grads["w"].alias("g")).first().g == pytest.approx(2 * np.mean([v * (2 * v - 1) for v in b]) + 2.0)
    with pytest.raises(ValueError):
        D.dual(X.feature(0), [F.col("a")], [X.const(1)])


def test_payloads(spark):
    deep = '{"z": ' * 40 + '"end"' + "}" * 40
    rows = [(1, '{"b": [1, {"c": " x "}, [], [2.5, [true]]], "a": null, " k ": ""}'), (2, None), (3, "no json {"), (4, '"  "'), (5, "[]"), (6, deep), (7, "12"), (8, '[[["a"],"b"],"c"]')]
    got = {r.id: r.strings for r in payloads.flattened(spark.createDataFrame(rows, "id int, p string"), "id", "p").collect()}
    assert sorted(got[1]) == sorted(["a", "b", "1", "c", "x", "2.5", "true", "k"]) and got[1].index("b") < got[1].index("1") < got[1].index("c") < got[1].index("x") < got[1].index("2.5")
    assert got[6] == ["z"] * 40 + ["end"] and got[7] == ["12"] and got[8] == ["a", "b", "c"]
    assert all(got[i] == [] for i in (2, 3, 4, 5))
    table = spark.createDataFrame(rows, "id int, p string").withColumn("key", F.col("id").cast("string"))
    assert payloads.point_read(table, "key", "1", "p", "$.b[1].c").first().value == " x "
    assert payloads.point_read(table, "key", "1", "p", "$.b[0]", "int").first().value == 1
    assert payloads.point_read(table, "key", "3", "p", "$.b").first().value is None
    with pytest.raises(KeyError):
        payloads.point_read(table, "key", "9", "p", "$.b")


def test_store_replaces_in_one_commit(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    frame = lambda *v: spark.createDataFrame([(i, i * 10) for i in v], "k int, v int")
    assert store.state() == (0, {}) and store.profiles() == []
    store.replace("a", frame(1, 2))
    store.replace("b", frame(5))
    reader = store.read("a")
    broken = frame(3).withColumn("v", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        store.replace("a", broken)
    assert {r.k for r in store.read("a").collect()} == {1, 2}  # the old profile is whole
    store.replace("a", frame(3))
    assert {r.k for r in store.read("a").collect()} == {3} and {r.k for r in store.read("b").collect()} == {5}
    assert {r.k for r in reader.collect()} == {1, 2}  # a reader keeps the state that it began with
    assert store.clean() == 2 and {r.k for r in store.read("a").collect()} == {3}
    store.drop("b")
    assert store.profiles() == ["a"]
    for missing in (store.read, store.drop):
        with pytest.raises(KeyError):
            missing("b")


def test_store_upserts_and_conflicts(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    rows = lambda *v: spark.createDataFrame(list(v), "k string, n int, v int")
    store.upsert("p", rows(("a", 1, 10), (None, 1, 20), ("b", None, 30)), ["k", "n"])
    store.upsert("p", rows(("a", 1, 11), (None, 1, 21), ("c", 1, 40)), ["k", "n"])
    assert {(r.k, r.n, r.v) for r in store.read("p").collect()} == {("a", 1, 11), (None, 1, 21), ("b", None, 30), ("c", 1, 40)}
    number, folders = store.state()
    store.replace("q", rows(("x", 1, 1)))
    with pytest.raises(Conflict):
        store._commit(number, folders)
    assert store.profiles() == ["p", "q"]
    other = TableStore(spark, str(tmp_path / "store"))

    def meanwhile(profile_rows):  # another writer commits while this one stages
        if meanwhile.left:
            meanwhile.left -= 1
            other.replace("r", rows(("y", 1, 2)))
        return profile_rows

    meanwhile.left = 1
    store._change("q", lambda _: meanwhile(rows(("z", 1, 3))), 3)
    assert store.profiles() == ["p", "q", "r"] and store.read("q").first().k == "z"


def test_outcomes_as_a_stream(spark, tmp_path):
    """Stream and batch agree, over a restart from the checkpoint and with records that come again."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", counters.ROCKSDB)
    try:
        rng = random.Random(5)
        rows = [(f"e{rng.randrange(4)}", f"r{i}", rng.choice([True, False, None]), rng.randrange(100) / 4, rng.randrange(100) / 4) for i in range(60)]
        schema = "expr string, id string, ok boolean, delta double, score double"
        folder, store = str(tmp_path / "in"), TableStore(spark, str(tmp_path / "store"))
        parts = [rows[:25] + rows[5:10], rows[20:45], rows[40:] + rows[:3]]

        def work():
            log = events.read(spark, folder, spark.createDataFrame([], schema).schema)
            records = counters.outcomes(log, ["expr"], "id", F.col("ok"), F.col("delta"), F.col("score"))
            query = counters.upsert(counters.stream(records, ["expr"]), ["expr"], store, "stats", str(tmp_path / "checkpoint"))
            query.awaitTermination(300)

        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
            if k != 1:  # the second part is worked off after a restart, with the third
                work()
        want = counters.totals(counters.outcomes(spark.createDataFrame(rows, schema), ["expr"], "id", F.col("ok"), F.col("delta"), F.col("score")), ["expr"])
        columns = ["expr", *counters._NAMES]
        assert sorted(map(tuple, store.read("stats").select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_index_finds_what_a_scan_finds(spark):
    rng = random.Random(8)
    words = ["river", "ration", "nation", "É t é", "glass", "NATIONAL", "rivers", "it"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7)))) for i in range(80)] + [(90, None), (91, ""), (92, "it")]
    table = spark.createDataFrame(rows, "id int, text string")
    index = TextIndex(spark).build(table, "id", "text")
    for tokens in (["river"], ["RIVER", "nation"], ["national"], ["é t é"], ["it"], [], ["xyz"], ["glass", "qqq"], ["it", "river"]):
        want = {i for i, t in rows if t is not None and all(k.lower() in t.lower() for k in tokens)} if tokens else {i for i, _ in rows}
        assert {r.id for r in index.search(table, "id", "text", tokens).collect()} == want
    near = index.candidates(["national"])
    hits = {i for i, t in rows if t and "national" in t.lower()}
    assert hits <= {r.key for r in near.collect()} and near.count() < 80
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [IsNotNull" not in plan.split("Location")[0]
    assert [(r.id, r.score) for r in index.top(table, "id", "text", ["river", "glass"], 5).collect()] == sorted(((i, s) for i, t in rows if (s := sum(w in (t or "").lower() for w in ("river", "glass")))), key=lambda x: (-x[1], x[0]))[:5]


def test_index_holds_lists_by_segment(spark):
    """A row for each gram of a segment; every text's grams are held once, those beyond the basic plane and on any partitioning too."""
    rows = [(i, t) for i, t in enumerate(["abcabc", "ABC\U0001f600\U0001f600x", "ab", "", None, "xabcx" * 50, "\U0001f600\U0001f600x"])]
    table = spark.createDataFrame(rows, "id int, text string")
    want = sum(len({t.lower()[k : k + 3] for k in range(len(t.lower()) - 2)}) for _, t in rows if t)
    for parts in (1, 3):
        index = TextIndex(spark).build(table.repartition(parts), "id", "text")
        lists = index.postings().select("bucket", "gram", "keys", "n").collect()
        assert sum(r.n for r in lists) == sum(len(set(r["keys"])) for r in lists) == want
        assert parts > 1 or len(lists) == len({r.gram for r in lists}) < want
        assert {r.id for r in index.search(table, "id", "text", ["\U0001f600\U0001f600X"]).collect()} == {1, 6}


@pytest.mark.parametrize("radius,pivots", [(0.3, 8), (1.0, 3), (5.0, 16)])
def test_near_vectors_by_brute_force(spark, radius, pivots):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 3, (5, 4))
    x = centres[rng.integers(0, 5, 200)] + rng.normal(0, 0.3, (200, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300 + i, x[3].tolist()) for i in range(40)] + [(400, None), (401, [float("nan")] * 4), (402, [1.0]), (403, [])]
    found, distinct = near_vectors.near_pairs(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", radius, pivots)
    got = {(r.a, r.b): r.distance for r in found.collect()}
    want = {(i, j): d for i in range(200) for j in range(i + 1, 200) if (d := float(np.linalg.norm(x[i] - x[j]))) <= radius}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert {r.id: r.copies for r in distinct.collect()}[3] == 41
    if radius < 1:
        assert near_vectors.candidates(distinct.where("size(v) = 4"), radius, pivots).count() < 200 * 199 / 2 / 5


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_near_vectors_by_products_and_by_cells(spark, monkeypatch, dense):
    """Both ways find the same pairs: many dimensions and a wide radius, more chunks than one, some of them empty."""
    monkeypatch.setattr(near_vectors, "DENSE", dense)
    monkeypatch.setattr(near_vectors, "CHUNK_ROWS", 7)
    monkeypatch.setattr(near_vectors, "TILE", 4)
    x = np.random.default_rng(3).normal(0, 1, (60, 16))
    df = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>")
    found, _ = near_vectors.near_pairs(df, "id", "v", 5.0)
    got = [(r.a, r.b, r.distance) for r in found.collect()]
    want = {tuple(sorted((f"k{i}", f"k{j}"))): float(np.linalg.norm(x[i] - x[j])) for i in range(60) for j in range(i)}
    want = {k: d for k, d in want.items() if d <= 5.0}
    assert len(got) == len(want) > 100 and all(d == pytest.approx(want[a, b]) for a, b, d in got)
    # Products join no rows.
    assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == (dense > 1)


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, v array<float>")
    assert near_vectors.near_pairs(empty, "id", "v", 1.0)[0].count() == 0
    with pytest.raises(ValueError):
        near_vectors.near_pairs(spark.createDataFrame([(1, [1.0])], "id int, v array<float>"), "id", "v", 0.0)


def test_payloads_are_opened_within_their_rows(spark):
    """Payloads deeper than one pass, with rows of one key, and no join or aggregate that gathers pieces."""
    deep = '{"k": [" x ", ' * 9 + "null, 1.5" + "]}" * 9
    rows = [(1, deep), (1, '{"b": {"z": true, "a": [[]]}, "a": "  "}'), (2, None), (3, "{broken"), (4, "[7, {}]")]
    out = payloads.flattened(spark.createDataFrame(rows, "id int, p string"), "id", "p")
    assert sorted((r.id, list(r.strings)) for r in out.collect()) == [(1, ["a", "b", "a", "z", "true"]), (1, ["k", "x"] * 9 + ["1.5"]), (2, []), (3, []), (4, ["7"])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_pool_changes_are_one_aggregate(spark):
    """Keys that come twice or are null are one key; no side is sorted for a join."""
    before, after = (spark.createDataFrame([(k,) for k in ks], "key string") for ks in (["a", "a", "b", None, "c"], ["b", "d", "d", None]))
    out = pool.changes(before, after, "key")
    assert sorted(map(tuple, out.collect())) == [("a", "removed"), ("c", "removed"), ("d", "added")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_role_companions_by_brute_force(spark):
    """The first others of a kind, for kinds smaller and larger than the number of roles; entries are not sorted by key for them."""
    rng = random.Random(4)
    kinds = {f"k{i}": rng.choice(["a", "a", "a", "b", "c", None]) for i in range(40)} | {"z": "alone"}
    table = spark.createDataFrame(list(kinds.items()), "key string, kind string")
    out = catalog.neighbours(table, 5)
    want = {(k, "role_companion", o) for k, kind in kinds.items() if kind for o in sorted(o for o, x in kinds.items() if x == kind and o != k)[:5]}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_pruning_equals_the_walk(spark):
    rng = random.Random(11)
    rows = [(f"t{i}", "f", float(rng.randrange(3)), [i], round(rng.uniform(-1, 1), 1)) for i in range(60)]
    pairs = [(f"t{i}", f"t{j}", rng.choice([0.5, -0.97, 0.99, None])) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.15]
    pairs += [(f"t{i}", f"t{i + 1}", 1.0) for i in range(20)] + [("t5", "t5", 1.0), ("t5", "gone", 1.0)]
    table, links = spark.createDataFrame(rows, pool.POOL), spark.createDataFrame(pairs, "a string, b string, corr double")
    close, kept = {frozenset((a, b)) for a, b, c in pairs if c is not None and abs(c) >= 0.95}, []
    for row in sorted(rows, key=lambda r: (-abs(r[4]), r[2], r[0])):
        if not any(frozenset((row[0], k)) in close for k in kept):
            kept.append(row[0])
    assert {r.name for r in pool.prune_redundant(table, links, 0.95).collect()} == set(kept)
    assert pool.prune_redundant(table, links.limit(0), 0.95).count() == 60


def test_draws_follow_the_softmax_on_any_partitioning(spark):
    logits = [2.0, 1.0, 0.0, -1.0, 2.0, None, float("nan")]
    df = spark.createDataFrame([(g, t, v) for g in (1, 2) for t, v in enumerate(logits)], "g int, t int, l double")
    out = sampling.next_tokens(df, ["g"], "t", "l", 0.5, 3, 9, 4000)
    got = out.groupBy("g", "token").count().collect()
    again = sampling.next_tokens(df.repartition(7), ["g"], "t", "l", 0.5, 3, 9, 4000)
    assert again.exceptAll(out).isEmpty() and out.exceptAll(again).isEmpty()
    weight = {0: math.exp(4), 4: math.exp(4), 1: math.exp(2)}
    for g in (1, 2):
        share = {r.token: r["count"] / 4000 for r in got if r.g == g}
        assert share.keys() == weight.keys() and all(abs(share[t] - w / sum(weight.values())) < 0.03 for t, w in weight.items())
    assert {(r.g, r.token) for r in sampling.next_tokens(df, ["g"], "t", "l", 0).collect()} == {(1, 0), (2, 0)}
    with pytest.raises(ValueError):
        sampling.next_tokens(df, ["g"], "t", "l", top_k=0)
    chances = spark.createDataFrame([(i, 3.0 if i < 500 else 1.0) for i in range(1000)] + [(2000, 0.0)], "i int, w double")
    drawn = [r.i for r in sampling.weighted_sample(chances, "i", "w", 200, 4).collect()]
    assert len(set(drawn)) == 200 and 2000 not in drawn and 120 < sum(i < 500 for i in drawn) < 175
