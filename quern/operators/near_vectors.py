"""Pairs of vectors within a radius, exactly and without all pairs: cells around pivots and the triangle inequality.

Each vector is at home in the cell of its nearest pivot, in a ring of its distance to it. It visits every cell whose pivot is at most twice the radius
farther than its own, as only there can a neighbour be at home, and there the rings next to its distance. Visits meet homes in an
equi-join on cell and ring, which adaptive execution splits where one is crowded; pairs whose distances to the pivot
differ by more than the radius go before their vectors are compared. Equal vectors are one, with their number.

Where the radius is wide against the vectors' distances (many dimensions), cells leave most pairs to be compared. Then vectors are dealt into
chunks, every two chunks meet in one partition, and products of matrices leave the pairs whose distances are worked out. Which way is
taken is judged by a sample and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import materialize

#: Rows that pivots are chosen from, and pivots.
SAMPLE, PIVOTS = 2048, 48
#: From this share of all pairs on that the cells leave (in the sample), chunks are multiplied instead.
DENSE = 0.005
#: Rows and bytes of a chunk at most, chunks at least (for parallel work), and rows multiplied at once.
CHUNK_ROWS, CHUNK_BYTES, CHUNKS, TILE = 32768, 1 << 25, 16, 1024


def distinct_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id (the smallest key), v (doubles) and copies of each distinct vector; null vectors and those with null or non-finite parts go."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(F.col(key).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "v", "copies")


def _sample(rows: DataFrame) -> np.ndarray:
    """At most ``SAMPLE`` vectors that a hash chooses."""
    chosen = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    return np.array(chosen, float) if chosen else np.empty((0, 0))


def _pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Points of ``x`` far from each other."""
    if not len(x):
        return x
    picked, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(count, len(x)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[picked[-1]], axis=1))
    return x[picked]


def _place(pivots: np.ndarray, radius: float, visits: bool):
    """A mapper of (id, v) to id, v, cell, ring and d (to the cell's pivot): at home, or where a vector visits."""
    slack = 1e-9 * (1 + float(np.abs(pivots).max()))  # for rounding: a cell too many does no harm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            d = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)
            home = d.argmin(axis=1)
            row, cell = (np.arange(len(x)), home) if not visits else np.nonzero(d <= d[np.arange(len(x)), home][:, None] + 2 * radius + slack)
            at = d[row, cell]
            ring = np.floor(at / radius).astype(np.int64)
            if visits:
                row, cell, at = (np.repeat(a, 3) for a in (row, cell, at))
                ring = (ring[:, None] + np.array([-1, 0, 1])).ravel()
            take = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), pa.array(cell), pa.array(ring), pa.array(at)], names=["id", "v", "cell", "ring", "d"])

    return run


def _left(x: np.ndarray, points: np.ndarray, radius: float) -> float:
    """The share of the sample's pairs that cells and rings leave to be compared."""
    d = np.stack([np.linalg.norm(x - p, axis=1) for p in points], axis=1)
    own = d.min(axis=1)
    home, pairs = d.argmin(axis=1), 0
    for c in range(len(points)):
        guests, hosts = d[d[:, c] <= own + 2 * radius, c], np.sort(own[home == c])
        pairs += int((np.searchsorted(hosts, guests + radius, "right") - np.searchsorted(hosts, guests - radius)).sum())
    return pairs / max(1, len(x)) ** 2


def candidates(rows: DataFrame, radius: float, pivots: int = PIVOTS) -> DataFrame:
    """a, b (a < b) and their vectors x and y: the pairs that are compared. ``rows`` has id and v of one length."""
    if not radius > 0:
        raise ValueError("the radius must be positive")
    return _candidates(rows, _pivots(_sample(rows), pivots), radius)


def _candidates(rows: DataFrame, points: np.ndarray, radius: float) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, v array<double>, cell long, ring long, d double"
    if not len(points):
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("v").alias("x"), F.col("v").alias("y")).limit(0)
    slim = rows.select("id", "v")
    homes = slim.mapInArrow(_place(points, radius, False), shape).select(F.col("id").alias("b"), F.col("v").alias("y"), "cell", "ring", F.col("d").alias("e"))
    visits = slim.mapInArrow(_place(points, radius, True), shape).select(F.col("id").alias("a"), F.col("v").alias("x"), "cell", "ring", "d")
    close = F.abs(F.col("d") - F.col("e")) <= radius * (1 + 1e-9) + 1e-9
    return visits.join(homes, ["cell", "ring"]).where((F.col("a") < F.col("b")) & close).select("a", "b", "x", "y")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def _dealt(rows: DataFrame, n: int, length: int) -> DataFrame:
    """id, v, pair of chunks and side of it (-1, 1; 0: a chunk with itself): each row once for each chunk, and each pair of chunks a partition."""
    most = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * length)))
    k = max(-(-n // most), min(CHUNKS, -(-n // TILE)), 1)
    own = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(k)).alias("own"))
    met = own.select("id", "v", "own", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = met.select("id", "v", (high * (high + 1) / 2 + low).cast("int").alias("pair"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"))
    return met.repartitionById(k * (k + 1) // 2, "pair")


def _multiplied(rows: DataFrame, n: int, length: int, radius: float) -> DataFrame:
    """a, b and distance of the pairs within ``radius``, by products of chunks."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, list] = {-1: [], 0: [], 1: []}
        for batch in batches:
            at = batch.column(3).to_numpy()
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for s in np.unique(at).tolist():
                own = np.flatnonzero(at == s)
                sides[s].append((batch.column(0).take(pa.array(own)), v[own]))
        lone = bool(sides[0])
        if not lone and not (sides[-1] and sides[1]):
            return
        (a, x), (b, y) = ((pa.concat_arrays([i for i, _ in s]), np.concatenate([v for _, v in s])) for s in ((sides[0],) * 2 if lone else (sides[-1], sides[1])))
        step = max(1, CHUNK_BYTES // (16 * length))
        nx, ny = (np.einsum("ij,ij->i", z, z) for z in (x, y))
        # Squared distances as one product; what rounding may add is allowed for, and the distances of what is left are exact.
        wide = np.column_stack([y, np.ones(len(y)), ny]).T
        bound = radius * radius * (1 + 1e-9) + 8 * (length + 4) * np.finfo(float).eps * (nx.max() + ny.max())
        for i in range(0, len(x), TILE):
            own = np.column_stack([-2 * x[i : i + TILE], nx[i : i + TILE], np.ones(len(x[i : i + TILE]))])
            for j in range(i if lone else 0, len(y), TILE):
                p, q = np.nonzero(~(own @ wide[:, j : j + TILE] > bound))
                p, q = p + i, q + j
                if lone:
                    p, q = p[p < q], q[p < q]
                for t in range(0, len(p), step):
                    d = _distances(x[p[t : t + step]], y[q[t : t + step]])
                    keep = np.flatnonzero(d <= radius)
                    yield pa.RecordBatch.from_arrays([a.take(pa.array(p[t + keep])), b.take(pa.array(q[t + keep])), pa.array(d[keep])], names=["a", "b", "distance"])

    found = _dealt(rows, n, length).mapInArrow(run, f"a {kind}, b {kind}, distance double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def near_pairs(df: DataFrame, key: str, vector: str, radius: float, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(a, b and distance of every two distinct vectors within ``radius``; id, v and copies of the distinct vectors).

    Vectors of other lengths than that of most are left out of the pairs.
    """
    rows = materialize(distinct_vectors(df, key, vector), "near-vectors")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = common.n if common else 0
    if not radius > 0:
        raise ValueError("the radius must be positive")
    even = rows.where((F.size("v") == length) & (F.size("v") > 0))
    x = _sample(even)
    points = _pivots(x, pivots)
    if len(x) and _left(x, points, radius) >= DENSE:
        return _multiplied(even, common["count"], length, radius), rows
    found = _candidates(even, points, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (2, 3))
            d = _distances(x, y)
            keep = pa.array(np.flatnonzero(d <= radius))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(d[keep.to_numpy()])], names=["a", "b", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return found.mapInArrow(run, f"a {kind}, b {kind}, distance double"), rows
