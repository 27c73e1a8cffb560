"""Feature pools: score candidate columns in one aggregate, then rank, limit and prune their metadata.

A pool is a small table (one row a candidate); data columns are never turned into arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import primitives as P
from quern.functions.guards import clip, finite
from quern.operators import moments, quantiles, timeseries
from quern.runtime import hand_over, materialize, scope

POOL = "name string, family string, complexity double, features array<int>, prior_corr double"


def candidates(columns: list[str], initial: bool = True, pairs: bool = True, top: int | None = None) -> list[tuple[str, str, float, list[int], Column]]:
    """(name, family, cost, feature places, column) of unary and pair candidates, i < j in pairs."""
    keep = True if initial else None
    out = [(f"{n}({c})", P.UNARY[n].family, P.UNARY[n].cost, [i], P.unary(n, F.col(c))) for i, c in enumerate(columns) for n in P.named(initial=keep)]
    if pairs:
        used = list(enumerate(columns))[:top]
        out += [
            (f"{n}({a},{b})", P.PAIR[n].family, P.PAIR[n].cost, [i, j], P.pair(n, F.col(a), F.col(b)))
            for k, (i, a) in enumerate(used)
            for j, b in used[k + 1 :]
            for n in P.named(initial=keep, pairs=True)
        ]
    return out


def nested(terms: list[tuple[str, str, float, list[int], Column]], names: list[str] | None = None, top: int | None = None) -> list[tuple[str, str, float, list[int], Column]]:
    """Unary candidates over other candidates: one level deeper, with the sum of both costs."""
    return [
        (f"{n}({t[0]})", P.UNARY[n].family, P.UNARY[n].cost + t[2], t[3], P.unary(n, t[4])) for t in terms[:top] for n in names or P.named(initial=True) if n != "identity"
    ]


def score(df: DataFrame, terms: list[tuple[str, str, float, list[int], Column]], target: str) -> DataFrame:
    """The pool table with each term's correlation to ``target``: one pass over the data for all.

    A pool is limited (``moments.MOST_COLUMNS``), so its correlations fit the driver.
    """
    k = len(terms)
    found = {r.i: r.corr for r in moments.correlations(df, [*(t[4] for t in terms), F.col(target)]).where(F.col("j") == k).collect()}
    return df.sparkSession.createDataFrame([(t[0], t[1], float(t[2]), t[3], float(found[i])) for i, t in enumerate(terms)], POOL)


ORDER: Callable[[], list[Column]] = lambda: [F.desc(F.abs("prior_corr")), F.asc("complexity"), F.asc("name")]


def top_by_corr(pool: DataFrame, n: int) -> DataFrame:
    return pool.orderBy(*ORDER()).limit(n)


def family_quota(pool: DataFrame, budget: dict[str, int]) -> DataFrame:
    """At most ``budget`` terms of each listed family, best first; other families pass."""
    rank = F.row_number().over(Window.partitionBy("family").orderBy(*ORDER()))
    limit = F.create_map(*(F.lit(x) for kv in budget.items() for x in kv)) if budget else F.create_map().cast("map<string,int>")
    allowed = F.try_element_at(limit, F.col("family"))
    return pool.withColumn("_r", rank).where(allowed.isNull() | (F.col("_r") <= allowed)).drop("_r")


def by_family(pool: DataFrame, family: str) -> DataFrame:
    """The terms of a family."""
    return pool.where(F.col("family") == family)


def frequency(pool: DataFrame) -> DataFrame:
    """How many terms each family and each feature has: kind, value, n."""
    one = pool.groupBy(F.col("family").alias("value")).agg(F.count("*").alias("n")).select(F.lit("family").alias("kind"), "value", "n")
    used = pool.select(F.explode(F.col("features").cast("array<string>")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return one.unionByName(used.select(F.lit("feature").alias("kind"), "value", "n"))


def min_corr(pool: DataFrame, threshold: float) -> DataFrame:
    return pool.where((F.abs("prior_corr") >= threshold) | (F.col("family") == "gate"))


def dedupe(pool: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key: a partial aggregate, so equal keys are thinned out before the shuffle."""
    first = pool.groupBy(key).agg(F.min_by(F.struct(*pool.columns), order).alias("_first"))
    return first.select("_first.*")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys added and removed between two pools, each once; null is a key.

    One aggregate over both sides, so a task holds one map of its keys, in place of both sides' sets, sorted, and twice.
    """
    side = lambda pool, n: pool.select(key, F.lit(n).cast("byte").alias("_side"))
    sides = side(before, 0).unionByName(side(after, 1)).groupBy(key).agg(F.min("_side").alias("_low"), F.max("_side").alias("_high"))
    return sides.where("_low = _high").select(key, F.when(F.col("_low") == 1, "added").otherwise("removed").alias("change"))



def correlation_pairs(df: DataFrame, columns: dict[str, Column], threshold: float = 0.0) -> DataFrame:
    """a, b and correlation of every pair of columns with at least ``threshold`` in size: one pass."""
    names = F.array(*(F.lit(n) for n in columns))
    found = moments.correlations(df, list(columns.values())).where(F.abs("corr") >= threshold)
    return found.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "corr")


def prune_redundant(pool: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Greedy: best first, a term stays if it correlates less than ``threshold`` with all that stay.

    Found in rounds of joins: a term without an open better neighbour stays, and its worse neighbours go. Each round settles the best
    open term of every connected part at least, so it takes as many rounds as the longest chain of neighbours that hinge on each other. Null
    correlations are no links; names are unique.
    """
    with scope(pool.sparkSession):
        # A term's place is its sort key, so the two ends of a link compare without a rank over the whole pool.
        place = F.struct((-F.abs("prior_corr")).alias("c"), F.col("complexity").alias("x"), F.col("name").alias("n"))
        terms = materialize(pool.select("name", place.alias("place")), "prune-terms")
        close = pairs.where((F.abs("corr") >= threshold) & (F.col("a") != F.col("b"))).select("a", "b")
        ends = terms.select(F.col("name").alias("a"), F.col("place").alias("p")), terms.select(F.col("name").alias("b"), F.col("place").alias("q"))
        close = close.join(ends[0], "a").join(ends[1], "b")
        better = F.col("p") < F.col("q")
        links = close.select(F.when(better, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(better, F.col("b")).otherwise(F.col("a")).alias("worse")).distinct()
        links = materialize(links, "prune-links")
        gone = terms.select("name").limit(0)
        while not links.isEmpty():
            # Better ends that are no open link's worse end stay; what they touch goes, and both leave the links.
            stays = links.select(F.col("better").alias("name")).distinct().join(links.select(F.col("worse").alias("name")), "name", "left_anti")
            out = materialize(links.join(stays.withColumnRenamed("name", "better"), "better", "left_semi").select(F.col("worse").alias("name")).distinct(), "prune-gone")
            gone = gone.unionByName(out)
            left = links.join(out.withColumnRenamed("name", "worse"), "worse", "left_anti").join(out.withColumnRenamed("name", "better"), "better", "left_anti")
            links = materialize(left, "prune-links")
        gone = hand_over(gone, "prune-all")
    return pool.join(gone, "name", "left_anti").select(*pool.columns)


def consensus(terms: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """key, support (distinct artifacts), ratio and whether it reaches the least support."""
    n = terms.agg(F.countDistinct("artifact").alias("_n"))
    out = terms.groupBy("key").agg(F.countDistinct("artifact").alias("support")).crossJoin(F.broadcast(n))
    return out.select("key", "support", (F.col("support") / F.col("_n")).alias("ratio"), (F.col("support") >= F.ceil(F.lit(min_ratio) * F.col("_n"))).alias("agreed"))


def overlap(terms: DataFrame) -> DataFrame:
    """Jaccard overlap of the key sets of each pair of artifacts: an equi-join on keys, not on pairs."""
    sets = terms.select("artifact", "key").distinct()
    size = sets.groupBy("artifact").agg(F.count("*").alias("n"))
    shared = sets.alias("l").join(sets.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.artifact") < F.col("r.artifact")))
    shared = shared.groupBy(F.col("l.artifact").alias("a"), F.col("r.artifact").alias("b")).agg(F.count("*").alias("shared"))
    out = shared.join(size.select(F.col("artifact").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("artifact").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def stability(df: DataFrame, value: Column, order: str | None = None) -> DataFrame:
    """q10, q50, q90 and deviation of a term's finite values, that of their successive differences, and the score.

    Differences are taken in the order of ``order`` (none are without it, and they count as 0). The
    score falls from 1 with the spread and the variation, in units of the term's size.
    """
    named = df.select(value.alias("v"), *([F.col(order).alias("o")] if order else []))
    rows = named.select(finite(F.col("v")).alias("v"), *(["o"] if order else [])).where("v is not null")
    q = quantiles.quantiles(rows, F.col("v"), [0.1, 0.5, 0.9]).select(*(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q10", "q50", "q90"))))
    shape = rows.agg(F.stddev_pop("v").alias("std"), F.count("*").alias("_n"))
    every = named.agg(F.count("*").alias("_all"))
    if order:
        step = timeseries.lag_table(rows, ["v"], "o", [], 1).select((F.col("v") - F.col("v_1")).alias("s")).agg(F.stddev_pop("s").alias("step_std"))
    else:
        step = df.sparkSession.createDataFrame([(0.0,)], "step_std double")
    out = q.crossJoin(F.broadcast(shape)).crossJoin(F.broadcast(every)).crossJoin(F.broadcast(step))
    size = F.greatest(F.lit(1.0), F.abs("q50"), F.col("std"))
    spread = F.least(F.lit(10.0), F.abs(F.col("q90") - F.col("q10")) / size)
    variation = F.when(F.col("_n") >= 3, F.least(F.lit(10.0), F.coalesce("step_std", F.lit(0.0)) / size)).otherwise(F.lit(0.0))
    share = F.coalesce(F.try_divide(F.col("_n").cast("double"), F.col("_all").cast("double")), F.lit(0.0))
    score = F.coalesce(clip(share / (1 + 0.35 * spread + 0.45 * variation), 0, 1), F.lit(0.0))
    return out.select("q10", "q50", "q90", "std", "step_std", score.alias("score"))


def overfit_guard(df: DataFrame, train: str, valid: str, max_gap: float = 0.25, max_ratio: float = 2.5, lower_is_better: bool = True) -> DataFrame:
    """gap, ratio, penalty and verdict of each row's train and valid score."""
    sign = 1 if lower_is_better else -1
    gap = sign * (F.col(valid) - F.col(train))
    ratio = F.try_divide(F.col(valid), F.greatest(F.abs(train), F.lit(1e-12)))
    over = F.greatest(gap - max_gap, F.lit(0.0)) + (F.greatest(ratio - max_ratio, F.lit(0.0)) if lower_is_better else F.lit(0.0))
    return df.select("*", gap.alias("gap"), ratio.alias("ratio"), over.alias("penalty"), (over <= 0).alias("passes"))


def lane_blend(df: DataFrame, lanes: dict[str, float], name: str = "prediction") -> DataFrame:
    """Weighted mean of lanes by the sizes of their weights; the plain mean if all are 0."""
    total = sum(map(abs, lanes.values()))
    weights = {c: w / total for c, w in lanes.items()} if total > 0 else dict.fromkeys(lanes, 1 / max(1, len(lanes)))
    value = F.lit(0.0)
    for column, weight in weights.items():
        value = value + F.lit(float(weight)) * F.col(column)
    return df.withColumn(name, value)


def rank_agreement(left: DataFrame, right: DataFrame, key: str, score: str, top: int) -> DataFrame:
    """Of the ``top`` keys of each of two rankings: how many are shared, and the share. Ties go by key."""
    best = lambda df: df.orderBy(F.desc(F.abs(score)), key).limit(top).select(key)
    return best(left).join(best(right), key).agg(F.count("*").alias("shared"), (F.count("*") / top).alias("agreement"))


def build(df: DataFrame, columns: list[str], target: str, budget: dict[str, int] | None = None, cap: int | None = None, pair_features: int | None = None) -> DataFrame:
    """A pool from scratch: unary candidates are scored, the features of the best give the pairs, and all are
    thinned out by family budget and cap.

    Two passes over the data, one for each generation; the pool itself is a small table.
    """
    first = score(df, candidates(columns, pairs=False), target)
    strength = first.select(F.get("features", F.lit(0)).alias("f"), F.abs("prior_corr").alias("c")).groupBy("f").agg(F.max("c").alias("c"))
    chosen = [r.f for r in strength.orderBy(F.desc("c"), "f").limit(pair_features or len(columns)).collect()]
    keep = {columns[i] for i in chosen}
    pairs = [t for t in candidates(columns) if len(t[3]) == 2 and {columns[i] for i in t[3]} <= keep]
    every = first.unionByName(score(df, pairs, target)) if pairs else first
    every = dedupe(every, "name", "complexity")
    out = family_quota(every, budget) if budget else every
    return top_by_corr(out, cap) if cap else out


def update(df: DataFrame, now: DataFrame, columns: list[str], residual: Column, features: int = 3, threshold: float = 0.0, redundancy: float = 0.995, cap: int = 50) -> tuple[DataFrame, DataFrame]:
    """The pool after a round: terms over the features that speak most to the residual are added, weak and redundant
    ones go, the best ``cap`` stay. Also what was added and removed."""
    from quern.operators.guards import signals

    strong = [r.feature for r in signals(df, residual, columns).limit(features).collect()]
    named = df.withColumn("_residual", residual)
    known = {r.name for r in now.select("name").collect()}
    every = {t[0]: t for t in candidates(columns, initial=False)}
    fresh = [t for t in every.values() if t[0] not in known and all(columns[i] in strong for i in t[3])]
    pool_ = now if not fresh else now.unionByName(score(named, fresh, "_residual"))
    pool_ = min_corr(pool_, threshold)
    names = [r.name for r in pool_.select("name").collect() if r.name in every]
    pairs = correlation_pairs(df, {n: finite(every[n][4]) for n in names}, redundancy)
    out = top_by_corr(prune_redundant(pool_, pairs, redundancy), cap)
    return out, changes(now, out, "name")
