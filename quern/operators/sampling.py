"""Weighted draws in one pass: seeded exponential keys, so any partitioning and any retry draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column) -> Column:
    """A number between 0 and 1 (both excluded) that the seed and the parts' texts decide: 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def next_tokens(df: DataFrame, by: list[str], token: str, logit: str, temperature: float = 1.0, top_k: int | None = None, seed: int = 0, draws: int = 1) -> DataFrame:
    """``by``, draw and a token of each group, drawn with probability softmax(logit / temperature) among its ``top_k`` best.

    The largest of logit / temperature plus a Gumbel number is such a draw, so a draw is a partial aggregate and no group is gathered.
    A temperature of 0 takes the best. Ties of logits go to the smaller token; null and NaN logits are never drawn.
    """
    if temperature < 0 or draws < 1 or (top_k is not None and top_k < 1):
        raise ValueError("temperature, draws and top_k are positive")
    rows = df.select(*by, F.col(token).alias("token"), F.col(logit).cast("double").alias("_l")).where(F.col("_l").isNotNull() & ~F.isnan("_l"))
    if top_k is not None:
        rows = _best(rows, by, top_k)
    if temperature == 0:
        rows, score = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))), F.col("_l")
    else:
        rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        u = uniform(seed, F.col("draw"), *map(F.col, by), F.col("token"))
        score = F.col("_l") / temperature - F.ln(-F.ln(u))
    first = rows.withColumn("_s", F.struct((-score).alias("s"), "token")).groupBy(*by, "draw").agg(F.min("_s").alias("_s"))
    return first.select(*by, "draw", F.col("_s.token").alias("token"))


def _best(rows: DataFrame, by: list[str], k: int, spread: int = 32) -> DataFrame:
    """The ``k`` best rows of each group: of hashed parts of it first, so no task sorts a whole group."""
    order = [F.desc("_l"), F.asc("token")]
    part = F.pmod(F.xxhash64("token"), F.lit(spread))
    near = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, part).orderBy(*order))).where(F.col("_r") <= k)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, with chances in proportion to ``weight``: the smallest exponential keys. A top-k, so no full sort."""
    rows = df.where(F.col(weight) > 0).withColumn("_e", -F.ln(uniform(seed, F.col(key))) / F.col(weight))
    return rows.orderBy("_e", key).limit(n).drop("_e")
