"""Metric aggregates: each is one ``agg`` over a prediction table, so partial sums do the work."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.distributions import erf
from quern.functions.guards import clip
from quern.runtime import materialize

TINY = 1e-12


def _r2(sse: Column, total: Column, mode: str) -> Column:
    """``exact``: 1 if both are 0, null if only the total is; ``floor``: 0 on a total up to 1e-12."""
    if mode == "floor":
        return F.when(total > TINY, 1 - F.try_divide(sse, total)).otherwise(F.lit(0.0))
    return F.when(total > 0, 1 - F.try_divide(sse, total)).when(sse <= 0, F.lit(1.0))


def regression(df: DataFrame, y: str, yhat: str, by: list[str] | None = None, r2_mode: str = "exact") -> DataFrame:
    """mse, rmse, mae and r2, in groups if ``by`` is given."""
    error = F.col(y) - F.col(yhat)
    out = df.groupBy(*(by or [])).agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.sum(error * error).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_total")
    )
    return out.select(*(by or []), "mse", F.sqrt("mse").alias("rmse"), "mae", _r2(F.col("_sse"), F.col("_total"), r2_mode).alias("r2"))


def interval(df: DataFrame, y: str, low: str, high: str) -> DataFrame:
    """Coverage, mean width, mean miss distance, and errors of the centre."""
    miss = F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high), F.lit(0.0))
    error = F.col(y) - (F.col(low) + F.col(high)) / 2
    inside = ((F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high))).cast("double")
    out = df.agg(
        F.avg(inside).alias("coverage"),
        F.avg(F.greatest(F.col(high) - F.col(low), F.lit(0.0))).alias("mean_width"),
        F.avg(miss).alias("mean_miss"),
        F.avg(error * error).alias("center_mse"),
    )
    return out.withColumn("center_rmse", F.sqrt("center_mse"))


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs on either side; 0 for empty sums."""
    pairs = df.groupBy(F.col(y).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("a")), F.struct(F.col("p").alias("c"), F.lit(0).alias("a")))).alias("s"), "y", "p", "n")
    out = sides.groupBy(F.col("s.c").alias("class")).agg(
        F.sum(F.when((F.col("s.a") == 1) & (F.col("y") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.a") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.a") == 0, F.col("n")).otherwise(0)).alias("predicted"),
    )
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    out = out.select("class", precision.alias("precision"), recall.alias("recall"), "support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("class", "precision", "recall", f1.alias("f1"), "support")


def macro(df: DataFrame, y: str, pred: str) -> DataFrame:
    per = confusion(df, y, pred)
    return per.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))


def binary_classification(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, error, log-loss and the positive class's precision, recall and F1."""
    prob = clip(F.col(p), TINY, 1 - TINY)
    hit = F.col(p) >= threshold
    true = F.col(y) == 1
    count = lambda c: F.sum(c.cast("long"))
    out = df.agg(
        F.avg((hit == true).cast("double")).alias("accuracy"),
        F.avg(-F.when(true, F.ln(prob)).otherwise(F.ln(1 - prob))).alias("log_loss"),
        count(hit & true).alias("_tp"),
        count(hit).alias("_pp"),
        count(true).alias("_p"),
    )
    precision, recall = F.coalesce(F.try_divide("_tp", "_pp"), F.lit(0.0)), F.coalesce(F.try_divide("_tp", "_p"), F.lit(0.0))
    out = out.select("accuracy", (1 - F.col("accuracy")).alias("error"), "log_loss", precision.alias("precision"), recall.alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counting half; 0.5 without both classes.

    Rows are first summed by distinct score, so the running total is over scores, cut into
    ranges: no single task sees all rows.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) != 1).cast("long")).alias("n"))
    run = running(by, "s", {"below": "n"}).withColumn("below", F.col("below") - F.col("n"))
    out = run.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return out.select(F.coalesce(F.try_divide(F.col("wins"), (F.col("np") * F.col("nn")).cast("double")), F.lit(0.5)).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, tie: str) -> DataFrame:
    """Mean precision at the positives in order of falling score; ties go by ``tie``."""
    rows = df.select(F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t")).alias("at"), (F.col(y) == 1).cast("long").alias("hit"), F.lit(1).cast("long").alias("one"))
    run = running(rows, "at", {"tp": "hit", "rank": "one"})
    return run.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("hit") == 1, F.col("tp") / F.col("rank"))), F.sum("hit").cast("double")), F.lit(0.0)).alias("average_precision"))


def running(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums in ``order`` over a whole table, without one window over all rows.

    The table is range-partitioned; each range is summed on its own, and the sums of the
    ranges before it, one row each, are added.
    """
    # Written once, so that both readers below see the same ranges.
    ranged = materialize(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *(F.sum(c).over(inside).alias(n) for n, c in sums.items())).join(F.broadcast(starts), "_range")
    return out.select(*df.columns, *((F.col(n) + F.col(f"_b_{n}")).alias(n) for n in sums))


def forecast(df: DataFrame, y: str, yhat: str, scale: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """mse, rmse, mae, mape, smape, bias, and mase if ``scale`` (a seasonal naive error) is given, in groups if ``by`` is.

    On a scale of 0, mase is 0 for errors up to 1e-12 and infinite for larger ones.
    """
    error = F.col(yhat) - F.col(y)
    out = df.groupBy(*(by or [])).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(TINY))).alias("mape"),
        F.avg(2 * F.abs(error) / F.greatest(F.abs(y) + F.abs(yhat), F.lit(TINY))).alias("smape"),
        F.avg(error).alias("bias"),
        *([F.max(scale).alias("_scale")] if scale is not None else []),
    ).withColumn("rmse", F.sqrt("mse"))
    if scale is None:
        return out
    flat = F.when(F.col("mae") <= TINY, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return out.withColumn("mase", F.when(F.col("_scale") > 0, F.try_divide("mae", "_scale")).otherwise(flat)).drop("_scale")


def naive_scale(df: DataFrame, y: str, order: str, by: list[str], period: int = 1) -> DataFrame:
    """Mean absolute seasonal difference of each series; lag 1 for series that are too short."""
    w = Window.partitionBy(*by).orderBy(order)
    diffs = df.select(*by, F.abs(F.col(y) - F.lag(y, period).over(w)).alias("m"), F.abs(F.col(y) - F.lag(y, 1).over(w)).alias("one"))
    return diffs.groupBy(*by).agg(F.coalesce(F.avg("m"), F.avg("one"), F.lit(0.0)).alias("scale"))


def route_distribution(df: DataFrame, route: str) -> DataFrame:
    """Rows and share of each branch."""
    out = df.groupBy(route).agg(F.count("*").alias("branch_count"))
    total = df.agg(F.count("*").alias("_n"))
    return out.crossJoin(F.broadcast(total)).select(route, "branch_count", (F.col("branch_count") / F.col("_n")).alias("ratio"))


def fold_summary(df: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation over folds of each numeric key; missing values are skipped."""
    used = [k for k in keys if k not in ignore]
    long = df.unpivot([], used, "metric", "value").where(F.col("value").isNotNull())
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def gaussian(df: DataFrame, y: str, mean: str, std: str, alpha: float = 0.1) -> DataFrame:
    """Of normal predictions: negative log-likelihood, continuous ranked probability score (crps), share of
    values in the central 1 - alpha interval (picp), and errors of the mean."""
    sigma = F.greatest(F.col(std), F.lit(1e-8))
    z = (F.col(y) - F.col(mean)) / sigma
    nll = 0.5 * z * z + F.ln(sigma) + 0.9189385332046727
    density = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    crps = sigma * (z * erf(z / math.sqrt(2)) + 2 * density - 1 / math.sqrt(math.pi))
    inside = (F.abs(F.col(y) - F.col(mean)) <= NormalDist().inv_cdf(1 - alpha / 2) * sigma).cast("double")
    error = F.col(y) - F.col(mean)
    return df.agg(F.avg(nll).alias("nll"), F.avg(crps).alias("crps"), F.avg(inside).alias("picp"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))


def triplets(df: DataFrame, anchor: str, positive: str, negative: str, margin: float = 1.0) -> DataFrame:
    """Share of anchors nearer to the positive, mean (squared, per coordinate) distances, and the hinge loss, of vector columns."""
    def far(a: str, b: str) -> Column:
        gaps = F.zip_with(F.col(a), F.col(b), lambda u, v: (u - v) * (u - v))
        return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)

    rows = df.select(far(anchor, positive).alias("p"), far(anchor, negative).alias("n"))
    return rows.agg(
        F.avg((F.col("p") < F.col("n")).cast("double")).alias("retrieval_accuracy"), F.avg("p").alias("positive_distance"), F.avg("n").alias("negative_distance"),
        F.avg(F.greatest(F.col("p") - F.col("n") + margin, F.lit(0.0))).alias("triplet_loss"),
    )


def preferences(df: DataFrame, chosen: str, rejected: str, ref_chosen: str | None = None, ref_rejected: str | None = None, beta: float = 0.1) -> DataFrame:
    """Loss and accuracy of preferences by log-probabilities of pairs, and the mean margins of policy and reference."""
    policy = F.col(chosen) - F.col(rejected)
    reference = F.col(ref_chosen) - F.col(ref_rejected) if ref_chosen and ref_rejected else F.lit(0.0)
    logit = beta * (policy - reference)
    # -log(sigmoid(x)) without overflow.
    loss = F.greatest(-logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))
    return df.agg(F.avg(loss).alias("dpo_loss"), F.avg((policy > reference).cast("double")).alias("preference_accuracy"), F.avg(policy).alias("policy_margin"), F.avg(reference).alias("reference_margin"))


def perplexity(cross_entropy: Column) -> Column:
    return F.exp(F.least(cross_entropy, F.lit(50.0)))
