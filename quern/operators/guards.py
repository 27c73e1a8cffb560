"""Scores and penalties of candidate terms and runs, as expressions over their metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.guards import clip, finite, safe_corr
from quern.operators import quantiles
from quern.runtime import materialize


def pole_safety(df: DataFrame, value: Column) -> DataFrame:
    """Quantiles 50, 95 and 99 of the size of a term, how close the tail stays to the middle, and the score.

    The score falls from 1 with the tail, with sizes beyond a million, and with values that aren't finite.
    """
    named = df.select(value.alias("v"))
    size = named.select(F.abs(finite(F.col("v"))).alias("v"))
    out = quantiles.quantiles(size, F.col("v"), [0.5, 0.95, 0.99]).select(*(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q50", "q95", "q99"))))
    share = size.agg(F.coalesce(F.try_divide(F.count("v").cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("_share"))
    out = out.crossJoin(F.broadcast(share)).withColumn("spread", F.try_divide(F.col("q99"), F.greatest(F.col("q50"), F.lit(1e-12))))
    tail = F.least(F.lit(20.0), F.col("q99") / F.greatest(F.col("q50"), F.lit(1.0)) / 10)
    beyond = F.when(F.col("q95") > 1e6, 1.0).otherwise(0.0)
    score = F.coalesce(clip(F.col("_share") / (1 + tail + beyond), 0, 1), F.lit(0.0))
    return out.select("q50", "q95", "q99", "spread", score.alias("score"))


def redundancy(pairs: DataFrame, threshold: float = 0.995) -> DataFrame:
    """Number of pairs at or over a correlation, and the largest."""
    return pairs.agg(F.sum((F.abs("corr") >= threshold).cast("long")).alias("redundant"), F.max(F.abs("corr")).alias("max_corr"))


def feature_reuse(pool: DataFrame) -> DataFrame:
    """How many terms use each feature; a term counts once."""
    return pool.select(F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(F.count("*").alias("terms"))


def structure_penalty(row: dict[str, Column], limits: dict[str, float], weights: dict[str, float]) -> Column:
    """Weighted sum of what each measure exceeds its limit by."""
    total = F.lit(0.0)
    for name, value in row.items():
        total = total + F.lit(float(weights.get(name, 1.0))) * F.greatest(value - F.lit(float(limits[name])), F.lit(0.0))
    return total


#: How native a family is to the grammar.
NATIVE = {
    1.0: ("seed", "basis_atom"),
    0.75: ("poly", "trig", "bounded", "saturation", "radial"),
    0.6: ("safe_log", "safe_exp", "safe_ratio", "interaction_ratio", "interaction_rational"),
}


def native_score(family: Column, complexity: Column) -> Column:
    """How native a term is: by family, less 0.02 for each unit of complexity over 4."""
    key = F.lower(F.trim(family))
    out = None
    for score, names in NATIVE.items():
        out = F.when(key.isin(*names), score) if out is None else out.when(key.isin(*names), score)
    out = out.when(F.contains(key, F.lit("gate")) | F.contains(key, F.lit("conditional")), 0.55)
    out = out.when(F.contains(key, F.lit("interaction")) | F.contains(key, F.lit("linear_combo")), 0.7).otherwise(0.35)
    return clip(out - 0.02 * F.greatest(complexity - 4, F.lit(0.0)), 0, 1.25)


#: The default limits and weights of a candidate's structure.
STRUCTURE = {
    "max_complexity": 24.0,
    "max_feature_reuse": 2,
    "max_duplicate_terms": 0,
    "redundancy_corr": 0.995,
    "min_stability": 0.12,
    "min_pole_safety": 0.12,
    "min_native": 0.0,
    "complexity_weight": 0.01,
    "reuse_weight": 0.25,
    "duplicate_weight": 0.5,
    "redundancy_weight": 0.25,
    "stability_weight": 0.5,
    "pole_weight": 0.5,
    "native_bonus": 0.02,
}
REASONS = ("complexity_budget", "seat_duplicate", "feature_reuse", "redundant_values", "chart_value_instability", "pole_safety", "native_structure_score")


def structure_guard(terms: DataFrame, pairs: DataFrame | None = None, config: dict[str, float] | None = None) -> DataFrame:
    """Penalty, bonus, reasons and verdict on the structure of each candidate.

    ``terms`` has candidate, key, family, complexity, features (array), and stability and pole_safety scores (null:
    no values). ``pairs`` has candidate and corr, a row for each pair of its terms. Every measure is one
    aggregate by candidate.
    """
    cfg = {**STRUCTURE, **(config or {})}
    per = terms.groupBy("candidate").agg(
        F.sum("complexity").alias("complexity"),
        (F.count("*") - F.countDistinct("key")).alias("duplicates"),
        F.coalesce(F.min("stability"), F.lit(1.0)).alias("stability"),
        F.coalesce(F.min("pole_safety"), F.lit(1.0)).alias("pole_safety"),
        F.avg(native_score(F.col("family"), F.col("complexity"))).alias("native"),
    )
    reuse = terms.select("candidate", F.explode(F.array_distinct("features")).alias("f")).groupBy("candidate", "f").agg(F.count("*").alias("n"))
    reuse = reuse.groupBy("candidate").agg(F.sum(F.greatest(F.col("n") - cfg["max_feature_reuse"], F.lit(0))).alias("reuse"))
    out = per.join(reuse, "candidate", "left")
    if pairs is None:
        out = out.withColumn("redundant", F.lit(0))
    else:
        close = pairs.groupBy("candidate").agg(F.sum((F.abs("corr") >= cfg["redundancy_corr"]).cast("long")).alias("redundant"))
        out = out.join(close, "candidate", "left")
    over = lambda c: F.greatest(c, F.lit(0.0))
    excess = [
        over(F.col("complexity") - cfg["max_complexity"]),
        over(F.col("duplicates") - cfg["max_duplicate_terms"]),
        F.coalesce("reuse", F.lit(0)).cast("double"),
        F.coalesce("redundant", F.lit(0)).cast("double"),
        over(cfg["min_stability"] - F.col("stability")),
        over(cfg["min_pole_safety"] - F.col("pole_safety")),
        over(cfg["min_native"] - F.col("native")),
    ]
    weights = [cfg[f"{w}_weight"] for w in ("complexity", "duplicate", "reuse", "redundancy", "stability", "pole")] + [1.0]
    penalty = F.lit(0.0)
    for value, weight in zip(excess, weights, strict=True):
        penalty = penalty + F.lit(float(weight)) * value
    named = F.array(*(F.when(e > 0, F.lit(r)) for e, r in zip(excess, REASONS, strict=True)))
    reasons = F.array_compact(named)
    return out.select("candidate", penalty.alias("penalty"), (cfg["native_bonus"] * F.col("native")).alias("bonus"), reasons.alias("reasons"), (F.size(reasons) > 0).alias("triggered"))


#: The default weights of a candidate's parts.
SCORE = {
    "objective": 1.0,
    "constraint": 1000.0,
    "prior_corr": 0.04,
    "complexity": 7e-4,
    "gradient_alignment": 0.02,
    "novelty": 0.01,
    "path_accept": 0.05,
    "duplicate": 0.5,
    "overfit": 1.0,
    "structure": 1.0,
}


def score_parts(row: dict[str, Column], weights: dict[str, float] | None = None) -> dict[str, Column]:
    """The eleven weighted parts of a candidate's score; smaller is better.

    ``row`` may have objective, violation (sum of broken constraints), prior_corr (mean size), complexity, alignment,
    mean_seen, accept_rate, duplicates, overfit, structure and bonus; what is missing counts as 0, and
    an accept_rate as 0.5. A broken constraint counts in the objective as well as on its own.
    """
    w = {**SCORE, **(weights or {})}
    get = lambda n, d=0.0: row.get(n, F.lit(d))
    violation = get("violation")
    return {
        "objective": w["objective"] * (get("objective") + w["constraint"] * violation),
        "constraint_penalty": w["constraint"] * violation,
        "prior_corr_bonus": -w["prior_corr"] * F.abs(get("prior_corr")),
        "complexity_penalty": w["complexity"] * get("complexity"),
        "gradient_alignment_bonus": -w["gradient_alignment"] * get("alignment"),
        "novelty_bonus": -w["novelty"] / (1 + get("mean_seen")),
        "path_accept_bonus": -w["path_accept"] * (get("accept_rate", 0.5) - 0.5),
        "duplicate_penalty": w["duplicate"] * get("duplicates"),
        "overfit_penalty": w["overfit"] * get("overfit"),
        "structure_guard_penalty": w["structure"] * get("structure"),
        "structure_native_bonus": -get("bonus"),
    }


def composite_score(row: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    total = F.lit(0.0)
    for part in score_parts(row, weights).values():
        total = total + part
    return total


def prior_rates(counts: DataFrame) -> DataFrame:
    """Rates derived from counters: acceptance (0.5 without outcomes), mean score, share of tries."""
    outcomes = F.col("success") + F.col("failure")
    accept = F.coalesce(F.try_divide(F.col("success").cast("double"), outcomes.cast("double")), F.lit(0.5))
    mean = F.coalesce(F.try_divide("score_sum", F.col("seen").cast("double")), F.lit(0.0))
    return counts.withColumns({"accept_rate": accept, "mean_score": mean})


def signals(df: DataFrame, residual: Column, features: list[str]) -> DataFrame:
    """Size of each feature's correlation with a residual, largest first: one aggregate."""
    items = F.array(*(F.struct(F.lit(c).alias("feature"), F.abs(safe_corr(F.col(c), residual)).alias("signal")) for c in features))
    return df.agg(items.alias("s")).select(F.inline("s")).orderBy(F.desc("signal"), "feature")


def masked_errors(ratings: DataFrame, users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Errors of a factorisation on observed cells, and their number.

    ``ratings`` has u, i, r; the factor tables have u or i and an array f of ``k`` numbers.
    """
    both = ratings.join(users.withColumnRenamed("f", "fu"), "u").join(items.withColumnRenamed("f", "fi"), "i")
    guess = F.aggregate(F.zip_with("fu", "fi", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    error = F.col("r") - guess
    return both.agg(F.avg(error * error).alias("mse"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.count("*").alias("observed"))


def pareto_front(df: DataFrame, key: str, objectives: list[str], cells: int = 64) -> DataFrame:
    """Rows that no other row beats in all objectives (smaller is better).

    With two objectives a row is on the front if its second is below the seconds of all rows
    before it, in order of the first: a running minimum, range by range.
    """
    first, *rest = objectives
    order = F.struct(*(F.col(c) for c in (*objectives, key)))
    if len(rest) != 1:
        raise ValueError("two objectives")
    ranged = materialize(df.repartitionByRange(cells, order).withColumn("_range", F.spark_partition_id()), "front")
    lows = ranged.groupBy("_range").agg(F.min(rest[0]).alias("_low"))
    lows = lows.withColumn("_before", F.min("_low").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.min(rest[0]).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.withColumn("_in", inside).join(F.broadcast(lows.select("_range", "_before")), "_range")
    best = F.least("_in", "_before")
    return out.where(best.isNull() | (F.col(rest[0]) < best)).select(*df.columns)
