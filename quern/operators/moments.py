"""Pairwise moments of many columns: products of small blocks by BLAS, summed as a DataFrame.

A pool has hundreds of columns, so thousands of pairs; an aggregate expression for each of them makes
plans that no code is generated for. Here every Arrow batch is turned into k x k sums of products of
columns less their means, and only these sums are shuffled, a row for each pair and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns at most; a batch's sums take 4 x k x k numbers.
MOST_COLUMNS = 2000
ROWS = 4096


def pair_sums(df: DataFrame, columns: list[Column]) -> DataFrame:
    """i, j (i <= j), n and the sums x, y, xx, yy, xy over rows where both columns have a finite value.

    Values are taken less their column's mean, so that sums of squares keep their digits.
    """
    k = len(columns)
    if k > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    names = [f"c{i}" for i in range(k)]
    rows = df.select(*(c.cast("double").alias(n) for c, n in zip(columns, names, strict=True)))
    fine = lambda n: F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), F.col(n))
    means = np.array([m or 0.0 for m in rows.agg(*(F.avg(fine(n)) for n in names)).first()])
    upper = np.triu_indices(k)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "xx", "yy", "xy"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, k, k))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                raw = np.column_stack([c.slice(a, ROWS).to_numpy(zero_copy_only=False) for c in batch.columns])
                has = np.isfinite(raw)
                value = np.where(has, raw - means, 0.0)
                held, square = has.astype(float), value * value
                sums += np.stack([held.T @ held, value.T @ held, held.T @ value, square.T @ held, held.T @ square, value.T @ value])
        flat = [s[upper] for s in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(flat[0].round().astype(np.int64)), *map(pa.array, flat[1:])], schema=schema
        )

    parts = rows.mapInArrow(run, "i int, j int, n long, x double, y double, xx double, yy double, xy double")
    return parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))


def correlations(df: DataFrame, columns: list[Column], tiny: float = 1e-12) -> DataFrame:
    """i, j (i < j) and corr of every pair; 0 without rows or without variance."""
    sums = pair_sums(df, columns).where("i < j")
    mean = lambda c: F.try_divide(F.col(c), F.col("n").cast("double"))
    var = lambda s, ss: F.greatest(mean(ss) - mean(s) * mean(s), F.lit(0.0))
    sx, sy = F.sqrt(var("x", "xx")), F.sqrt(var("y", "yy"))
    corr = F.when((F.col("n") > 0) & (sx > tiny) & (sy > tiny), (mean("xy") - mean("x") * mean("y")) / (sx * sy)).otherwise(F.lit(0.0))
    return sums.select("i", "j", corr.alias("corr"))


def basis_metrics(df: DataFrame, columns: list[Column], mean_over_all: bool = False) -> DataFrame:
    """One row of max_abs_corr, mean_abs_corr, rank and condition of a basis of columns.

    The mean is over the cells off the diagonal, or (``mean_over_all``) over all, with zeros on
    the diagonal. Rank and condition number come from the k x k products; a
    condition number that isn't finite counts as 1e12. Only those products reach the driver.
    """
    k = len(columns)
    if not k:
        raise ValueError("a basis has at least one column")
    gram, corr, n = np.zeros((k, k)), np.eye(k), 0
    for r in pair_sums(df, columns).collect():
        gram[r.i, r.j] = gram[r.j, r.i] = r.xy
        n = max(n, r.n)
        size = r.n or 1
        vx, vy = r.xx / size - (r.x / size) ** 2, r.yy / size - (r.y / size) ** 2
        if r.i != r.j:
            cov = r.xy / size - r.x * r.y / size**2
            corr[r.i, r.j] = corr[r.j, r.i] = cov / np.sqrt(vx * vy) if vx > 0 and vy > 0 else 0.0
    off = np.abs(corr - np.diag(np.diag(corr)))
    roots = np.sqrt(np.maximum(np.linalg.eigvalsh(gram), 0.0))[::-1]
    # Roots of the products carry half the digits, so the cut is taken from those of the products.
    rank = int((roots > roots[0] * np.sqrt(max(k, 1) * np.finfo(float).eps)).sum()) if roots[0] > 0 else 0
    condition = float(roots[0] / roots[-1]) if rank == k and roots[-1] > 0 else 1e12
    mean = off.sum() / max(1, k * k if mean_over_all else k * k - k)
    row = (float(off.max()), float(mean), float(rank), condition)
    return df.sparkSession.createDataFrame([row], "max_abs_corr double, mean_abs_corr double, rank double, condition double")


def value_overlap(df: DataFrame, atoms: list[tuple[str, str, Column]], threshold: float = 0.995) -> DataFrame:
    """a, b, their artifacts, abs_corr and whether it is high, of every pair of basis atoms.

    ``atoms`` lists (artifact, name, column); pairs within an artifact count too.
    """
    listed = df.sparkSession.createDataFrame([(k, a[0], a[1]) for k, a in enumerate(atoms)], "k int, artifact string, name string")
    side = lambda c, p: F.broadcast(listed.select(F.col("k").alias(c), F.col("artifact").alias(f"artifact_{p}"), F.col("name").alias(p)))
    found = correlations(df, [a[2] for a in atoms]).join(side("i", "a"), "i").join(side("j", "b"), "j")
    return found.select("a", "b", "artifact_a", "artifact_b", F.abs("corr").alias("abs_corr"), (F.abs("corr") >= threshold).alias("high"))
