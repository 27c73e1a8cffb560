"""Connected components by alternating stars, in rounds of joins and minima.

Every round is a distributed join and a partial minimum. The minima are written before they are joined back, so
both sides of that join are plain shuffles, and adaptive execution splits the rows of a hub with very
many neighbours; no neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import hand_over, materialize, scope


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    """Links each node's larger neighbours to its smallest neighbour or itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-least")
    return materialize(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct(), f"{name}-large")


def _small_star(edges: DataFrame, name: str) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them. Takes a < b."""
    least = materialize(edges.groupBy("b").agg(F.min("a").alias("m")), f"{name}-least")
    moved = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    kept = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.where("x != y").unionByName(kept).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """node and component (its smallest node) of every node that has a link.

    ``edges`` has columns a and b; loops, repeats and either direction are fine. Links with a
    null end are no links. The result is a table; what the rounds wrote is removed.
    """
    with scope(edges.sparkSession):
        now = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        now = materialize(now, f"{name}-edges")
        while True:
            after = materialize(_small_star(_large_star(now, name), name), f"{name}-stars")
            # Done when each larger node has one parent, and no parent is itself a child.
            many = after.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
            inner = after.select(F.col("a").alias("b")).join(after.select("b"), "b", "left_semi")
            if many.isEmpty() and inner.isEmpty():
                break
            now = after
        roots = after.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
        return hand_over(after.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots), f"{name}-components")
