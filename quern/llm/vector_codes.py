"""Vectors compressed to codes of parts, with codebooks fitted on balls of an anchors hierarchy.

Every chunk of vectors gets, for each part position, a metric tree that is built middle-out: about
sqrt(n) anchors are placed, each at the point furthest from its anchor so far, and take over the points that are
nearer to them (a point less than half the way to the new anchor from its own is not looked at);
neighbouring anchors are then merged upwards, and each anchor's own points are split downwards in the
same way. A ball caches its points' sum and count. A round of the fit walks the trees of all chunks from their roots
with the list of all entries; a ball drops from the list it inherits every entry that is farther than its nearest one
from each point it can hold, and is wholly owned once one entry is left: its cached sum and count are all that is needed.
Only leaves that more entries reach look at their points. The trees are written once and read in each round;
what a round sends to the driver are the sums of each entry, bounded by the codebooks' size.

All results are exact: distances of points are whole numbers, and a ball's test, in floating point, drops an entry only
beyond a margin for rounding; ties go to the lower entry.

Defined cases. Vectors that are null or hold null or non-finite components are dropped. Codebooks start from the first
``entries`` kept rows by vec_id, then by vector; null vec_ids come last, repeated ones each count; fewer rows
make fewer entries, and entries that equal an earlier one are never used. The length is the most common one that ``parts``
divides (ties: the shorter); kept rows of other lengths, or with components beyond ``limit(length)``, where sums of squares would pass
64 bits, take no part in the fit and get a null code and error. Null labels are one group. A label's error is null if all its rows' are.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.runtime import bounded_batches, hand_over, materialize, scope

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of a chunk of vectors, about, and points of a leaf.
CHUNK, LEAF = 1 << 20, 32


def limit(length: int) -> int:
    """The largest component, as an integer, for which all sums of squares stay below 2**62."""
    return isqrt(2**62 // length) // 2


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def anchors(points: np.ndarray, count: int) -> list[np.ndarray]:
    """The rows that each of at most ``count`` anchors owns; fewer if all points are on anchors."""
    pivots = [0]
    dist = _squares(points, points[0])
    owner = np.zeros(len(points), np.int64)
    while len(pivots) < count:
        far = int(dist.argmax())
        if dist[far] == 0:
            break
        way = _squares(points[pivots], points[far])
        near = np.flatnonzero(4 * dist.astype(np.float64) > 0.999999 * way[owner])
        new = _squares(points[near], points[far])
        won = new < dist[near]
        taken = near[won]
        owner[taken], dist[taken] = len(pivots), new[won]
        pivots.append(far)
    by = np.argsort(owner, kind="stable")
    return [x for x in np.split(by, np.cumsum(np.bincount(owner, minlength=len(pivots)))[:-1]) if len(x)]


class _Node:
    __slots__ = ("left", "right", "rows")

    def __init__(self, rows: np.ndarray | None, left: _Node | None = None, right: _Node | None = None):
        self.rows, self.left, self.right = rows, left, right


def _merge(points: np.ndarray, groups: list[np.ndarray], nodes: list[_Node]) -> _Node:
    """One tree of ``nodes``: the two whose common ball is smallest become one, again and again."""
    n = len(nodes)
    weight = np.array([len(g) for g in groups], np.float64)
    centre = np.array([points[g].mean(axis=0) for g in groups])
    radius = np.array([np.sqrt(_squares(points[g], c).max()) for g, c in zip(groups, centre, strict=True)])

    def balls(i: int, among: np.ndarray) -> np.ndarray:
        apart = np.sqrt(_squares(centre[among], centre[i]))
        return np.maximum((apart + radius[among] + radius[i]) / 2, np.maximum(radius[among], radius[i]))

    every = np.arange(n)
    cost = np.array([balls(i, every) for i in every])
    np.fill_diagonal(cost, np.inf)
    for _ in range(n - 1):
        i, j = divmod(int(cost.argmin()), n)
        size, total = cost[i, j], weight[i] + weight[j]
        centre[i] = (weight[i] * centre[i] + weight[j] * centre[j]) / total
        weight[i], radius[i] = total, size
        nodes[i] = _Node(None, nodes[i], nodes[j])
        cost[j], cost[:, j] = np.inf, np.inf
        live = np.flatnonzero(np.isfinite(cost[i]))
        cost[i, live] = cost[live, i] = balls(i, live)
        last = i
    return nodes[last]


def _grow(points: np.ndarray, rows: np.ndarray) -> _Node:
    if len(rows) <= LEAF:
        return _Node(rows)
    groups = [rows[g] for g in anchors(points[rows], isqrt(len(rows) - 1) + 1)]
    if len(groups) == 1:
        return _Node(rows)
    return _merge(points, groups, [_grow(points, g) for g in groups])


class Tree:
    """Balls over ``points``, as arrays; a ball's points are neighbours in ``order``."""

    FIELDS = ("points", "order", "start", "end", "left", "right", "radius")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)
        total = np.zeros((len(self.points) + 1, self.points.shape[1]), np.int64)
        np.cumsum(self.points, axis=0, out=total[1:])
        self.sums = total[self.end] - total[self.start]
        self.counts = self.end - self.start
        self.centre = self.sums / self.counts[:, None]

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        order, start, end, left, right, at = [], [], [], [], [], 0
        stack = [(_grow(points, np.arange(len(points))), None, 0)]
        while stack:
            node, parent, side = stack.pop()
            me = len(start)
            if parent is not None:
                (left, right)[side][parent] = me
            start.append(at)
            end.append(0)
            left.append(-1)
            right.append(-1)
            if node.rows is None:
                stack += [(node.right, me, 1), (node.left, me, 0)]
            else:
                order.append(node.rows)
                at += len(node.rows)
                end[me] = at
        for me in reversed(range(len(start))):  # children come after their parent
            if left[me] >= 0:
                end[me] = end[right[me]]
        order = np.concatenate(order)
        arrays = {"points": points[order], "order": order} | {k: np.array(v, np.int64) for k, v in (("start", start), ("end", end), ("left", left), ("right", right))}
        tree = cls(**arrays, radius=np.zeros(len(start)))
        far = [_squares(tree.points[a:b], c).max() for a, b, c in zip(start, end, tree.centre, strict=True)]
        tree.radius = np.sqrt(np.array(far)) * (1 + 1e-9)
        return tree

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        with np.load(io.BytesIO(blob)) as held:
            return cls(**{f: held[f] for f in cls.FIELDS})

    def walk(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each point (in ``order``), and sums and counts by entry."""
        entries = len(book)
        nearest = np.zeros(len(self.points), np.int64)
        sums, counts = np.zeros_like(book), np.zeros(entries, np.int64)
        apart = 2 * np.sqrt(_squares(book[:, None].astype(np.float64), book[None]))
        balls = np.zeros(1, np.int64)
        lists = np.array([[not (book[:j] == book[j]).all(axis=1).any() for j in range(entries)]])
        size = 1e-10 * (float(np.abs(book).max()) ** 2 + float(np.abs(self.points).max()) ** 2) * book.shape[1]
        while len(balls):
            dist = np.where(lists, _squares(self.centre[balls][:, None], book[None]), np.inf)
            first = dist.argmin(axis=1)
            least = dist[np.arange(len(balls)), first][:, None]
            # The difference of two squared distances is linear in the point: it varies by radius x apart.
            lists &= dist - least <= self.radius[balls][:, None] * apart[first] + 1e-9 * (np.where(lists, dist, 0) + least) + size
            whole = lists.sum(axis=1) == 1
            own, by = balls[whole], first[whole]
            np.add.at(sums, by, self.sums[own])
            np.add.at(counts, by, self.counts[own])
            for b, e in zip(own.tolist(), by.tolist(), strict=True):
                nearest[self.start[b] : self.end[b]] = e
            balls, lists = balls[~whole], lists[~whole]
            leaf = self.left[balls] < 0
            for b, among in zip(balls[leaf].tolist(), lists[leaf], strict=True):
                rows, open_ = slice(self.start[b], self.end[b]), np.flatnonzero(among)
                mine = open_[_squares(self.points[rows][:, None], book[open_][None]).argmin(axis=1)]
                nearest[rows] = mine
                np.add.at(sums, mine, self.points[rows])
                counts += np.bincount(mine, minlength=entries)
            inner, below = balls[~leaf], lists[~leaf]
            balls, lists = np.concatenate([self.left[inner], self.right[inner]]), np.concatenate([below, below])
        return nearest, sums, counts


def whole_numbers(column: pa.Array, length: int) -> np.ndarray:
    """floor(SCALE * x) of every component of a column of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, length)


def _trees(length: int, parts: int):
    """A mapper of (vec_id, label, embedding) to chunks: their ids, labels and one tree for each part."""
    most = max(LEAF, CHUNK // length)

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = np.concatenate([whole_numbers(c, length) for c in table.column(2).chunks])
        blobs = [Tree.build(p).dump() for p in np.split(x, parts, axis=1)]
        wide = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), table.column(i).combine_chunks()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*wide, pa.array([blobs], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                if rows + piece.num_rows > most:
                    yield chunk(held)
                    held, rows = [], 0
                held.append(piece)
                rows += piece.num_rows
        if rows:
            yield chunk(held)

    return run


def _sums(books: list[np.ndarray]):
    """A mapper of chunks to sums and counts by part, entry and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trees in batch.column(0):
                rows = []
                for part, (blob, book) in enumerate(zip(trees, books, strict=True)):
                    _, sums, counts = Tree.load(blob.as_py()).walk(book)
                    entry, place = (x.ravel() for x in np.indices(sums.shape))
                    rows.append(np.stack([np.full(sums.size, part), entry, place, sums.ravel(), counts[entry]]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(rows, axis=1)], names=["part", "entry", "place", "total", "n"])

    return run


def _assign(books: list[np.ndarray], kind: pa.DataType):
    """A mapper of chunks to vec_id, label, code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                digits, error = np.empty((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
                for part, (blob, book) in enumerate(zip(batch.column(2)[i], books, strict=True)):
                    tree = Tree.load(blob.as_py())
                    nearest, _, _ = tree.walk(book)
                    digits[tree.order, part] = nearest
                    error[tree.order] += _squares(tree.points, book[nearest])
                text = digits.tobytes().hex()
                wide = 2 * len(books)
                codes = [text[at : at + wide] for at in range(0, len(text), wide)]
                yield pa.RecordBatch.from_arrays([ids, labels.cast(kind), pa.array(codes, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _start(rows: list[Row], length: int, parts: int) -> list[np.ndarray]:
    x = np.array([[np.floor(SCALE * float(v)) for v in r.embedding] for r in rows]).reshape(len(rows), length).astype(np.int64)
    return np.split(x, parts, axis=1)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of ``vectors`` (vec_id, embedding, label).

    The result is a plan over a table in the shared folder; what the fit wrote is removed.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    bounded_batches(spark)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & ~bad)
    sizes = kept.groupBy(F.size("embedding").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0))
    common = sizes.orderBy(F.desc("count"), "n").first()
    if common is None:
        none = F.lit(None)
        return kept.select("vec_id", none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    length = common.n
    fits = (F.size("embedding") == length) & ~F.exists("embedding", lambda x: F.abs(x.cast("double")) * SCALE >= limit(length))
    with scope(spark):
        fitted = kept.where(fits)
        books = _start(fitted.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect(), length, parts)
        label = kept.schema["label"].dataType
        shape = T.StructType([T.StructField("ids", T.ArrayType(kept.schema["vec_id"].dataType)), T.StructField("labels", T.ArrayType(label)), T.StructField("trees", T.ArrayType(T.BinaryType()))])
        trees = materialize(fitted.mapInArrow(_trees(length, parts), shape), "codes-trees")
        for _ in range(rounds if len(books[0]) else 0):
            sums = trees.select("trees").mapInArrow(_sums(books), "part long, entry long, place long, total long, n long")
            for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
                books[r.part][r.entry, r.place] = r.total // r.n
        out = T.StructType([*kept.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        kind = pa.null() if isinstance(label, T.NullType) else None
        coded = trees.mapInArrow(_assign(books, kind or _arrow(label)), out)
        odd = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        coded = hand_over(coded.unionByName(odd), "codes")
        totals = hand_over(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, length: int = 64) -> str:
    """SQL of the contract for vectors that are all of one length."""
    wide = length // parts
    apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p.part, min({apart} * {entries} + entry) AS m FROM p JOIN c{k} ON c{k}.part = p.part GROUP BY 1, 2)")
        if k < rounds:
            steps.append(f"s{k} AS MATERIALIZED (SELECT p.part, m % {entries} AS entry, j, sum(x[j]) AS s, count(*) AS n FROM a{k} JOIN p USING (r, part), range(1, {wide + 1}) q(j) GROUP BY 1, 2, 3)")
            steps.append(f"u{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{k} GROUP BY 1, 2)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.c, b.c) AS c FROM c{k} b LEFT JOIN u{k} u ON u.part = b.part AND u.entry = b.entry)")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, k AS part, list_slice(e, k * {wide} + 1, (k + 1) * {wide}) AS x FROM v, range({parts}) t(k)),
c0 AS MATERIALIZED (SELECT part, r AS entry, x AS c FROM p WHERE r < {entries}),
{", ".join(steps)},
codes AS (SELECT r, string_agg(printf('%02x', CAST(m % {entries} AS INT)), '' ORDER BY part) AS code, sum(m // {entries}) AS error FROM a{rounds} GROUP BY 1),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM c{rounds})
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM v JOIN codes USING (r), digest
"""
