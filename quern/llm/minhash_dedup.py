"""Near-duplicate documents by circulant MinHash.

Two permutations make a whole signature. The first, sigma, scatters a shingle's hash over
``UNIVERSE`` places; the second, pi, is one table of distinct ranks, and coordinate k is the
smallest rank under pi shifted circularly by k. All coordinates of a shingle are thus one
contiguous slice of pi. Bands of coordinates are hashed to buckets, and documents that share a
bucket are candidates; links are confirmed by the exact Jaccard similarity of full shingle sets.

The numbers of bands and of rows in a band follow from the similarity asked for (``plan_bands``), so that a
pair exactly at the limit is missed with a probability of at most ``MISS``.

Large groups: documents with the same shingle set are one node. Inside a bucket nobody is
compared with everybody. Each bucket's most central member (the one whose buckets are largest) is
compared with the others, and the links found are joined into components. What is left is
lossless: of the nodes around one centre, those outside the largest component are compared with
the rest, in blocks bounded in nodes and in shingles, that give out links alone. As 1 - Jaccard is a metric, only nodes
whose distances to the centre differ by no more than a link's distance are compared. That last step is
quadratic, in block comparisons and not in rows, for a crowd of texts that share a bucket and are
yet unlike, such as forms with much common text: its work is spread over tasks of bounded memory but not avoided.

Sides of joins that aggregates made are written first (``materialize``), so that adaptive execution
can split the hot key of a bucket or a centre that a third of the documents share.

Defined cases: a null or empty text, or one of white space alone, has an empty set, is linked
with nothing and kept. A text of fewer words than a shingle has one shingle, the whole
sequence. Rows without a doc_id are kept, with a null component. Rows that share a doc_id are
one document, linked if any of its texts is. An empty table gives an empty result. Of equally
central members the one with the smallest doc_id is the centre. Columns
other than the two named are never looked at, and ``dedup`` returns them untouched. Batches hold
about ``BATCH_BYTES`` of texts, or one longer text, and a task a few arrays of its words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.components import connected_components
from quern.runtime import bounded_batches, hand_over, materialize, prune_joins, scope

UNIVERSE = 1 << 20
#: The probability that a pair exactly at the limit shares no bucket, at most.
MISS = 5e-7
#: Coordinates of a signature, at most; they bound how selective bands can be.
COORDINATES = 330
#: Nodes and shingles of a block of the last comparisons, at most (of shingles: of more than one node).
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
_SEED = 71


def plan_bands(percent: int) -> tuple[int, int]:
    """Bands and rows: the most rows for which bands enough for ``MISS`` fit in ``COORDINATES``.

    Below 5 percent none are enough; as many bands of one row are taken as there is room for.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    if percent == 100:
        return 1, 6
    best = None
    for rows in range(1, COORDINATES + 1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))
        if bands * rows > COORDINATES:
            break
        best = bands, rows
    return best or (COORDINATES, 1)


def _pi(width: int) -> np.ndarray:
    """pi, long enough that a slice of ``width`` never wraps."""
    ranks = np.random.Generator(np.random.PCG64(_SEED)).permutation(UNIVERSE).astype(np.uint32)
    return np.concatenate([ranks, ranks[:width]])


def signatures(sets: list[np.ndarray], width: int, pi: np.ndarray) -> np.ndarray:
    """One row of ``width`` coordinates for each non-empty set of shingle hashes."""
    slices = np.lib.stride_tricks.sliding_window_view(pi, width)
    out = np.full((len(sets), width), np.iinfo(np.uint32).max, dtype=np.uint32)
    for i, s in enumerate(sets):
        places = (W.mix(s ^ W.U64(_SEED)) >> W.U64(44)).astype(np.int64)
        for a in range(0, len(places), 2048):
            np.minimum(out[i], slices[places[a : a + 2048]].min(axis=0), out=out[i])
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket for each band; equal buckets of different bands stay apart."""
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for r in range(rows):
        out = W.mix(out * W.U64(0x9FB21C651E98DF25) + sig[:, r::rows][:, :bands].astype(np.uint64))
    return out


def _sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    for a, b in W.groups(texts):
        hashes, at = W.hash_words(texts[a:b], lower=True)
        for i in range(b - a):
            yield np.unique(W.shingles(hashes[at[i] : at[i + 1]], k))


def profile(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a digest of the whole set, and the buckets, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pi = _pi(bands * rows)
        for batch in batches:
            sets = list(_sets(W.utf8(batch.column(1)), k))
            buckets = band_hashes(signatures(sets, bands * rows, pi), bands, rows).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([b if len(s) else None for s, b in zip(sets, buckets, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "digest", "buckets"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, buckets array<long>"
    )


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and its distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in _sets(W.utf8(batch.column(1)), k)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "node long, shingles array<long>")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _block_links(percent: int):
    """Links between the rows of one block that are asked (side y) and its others (side x)."""

    def run(block: pa.Table) -> pa.Table:
        side = np.asarray(block["asked"])
        node, component = np.asarray(block["node"]), np.asarray(block["component"])
        sets = [np.asarray(s.values) for s in block["shingles"]]
        xs = np.flatnonzero(~side)
        out: list[tuple[int, int]] = []
        if len(xs) and side.any():
            values, place = np.unique(np.concatenate([sets[i] for i in xs]), return_inverse=True)
            sizes = np.array([len(sets[i]) for i in xs])
            starts = np.cumsum(sizes) - sizes
            held = np.zeros(len(values), np.int64)
            for y in np.flatnonzero(side):
                at = np.searchsorted(values, sets[y])
                at = at[at < len(values)]
                at = at[np.isin(values[at], sets[y])]
                held[at] = 1
                shared = np.add.reduceat(held[place], starts)
                held[at] = 0
                near = (100 * shared >= percent * (sizes + len(sets[y]) - shared)) & (component[xs] != component[y])
                # One link to each other component is enough.
                _, first = np.unique(component[xs[near]], return_index=True)
                out += [(int(node[y]), int(node[xs[near][i]])) for i in first]
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def _settle(stars: DataFrame, found: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links that the comparisons with the centres missed. ``stars`` has centre, node, its number of shingles n and far.

    With d = 1 - Jaccard, d(x, y) >= |d(x, centre) - d(y, centre)|, so nodes are laid into steps of
    a link's distance, and those of neighbouring steps are compared. Nodes of a centre's largest
    component are compared with those outside it, never with each other.
    """
    reach = 1 - percent / 100 + 1e-9
    label = stars.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    count = label.groupBy("centre", "component").agg(F.count("*").alias("n"))
    main = count.groupBy("centre").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds"))
    main = materialize(main.where("kinds > 1").select("centre", "main"), "minhash-main")
    opened = materialize(label.join(main, "centre").withColumn("step", F.floor(F.col("far") / reach)), "minhash-open")
    steps = F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step")
    asked = opened.where("component != main").select("centre", steps, "node", "component", "n")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    nx = opened.groupBy("centre", "step").agg(blocks.alias("bx"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    ny = asked.groupBy("centre", "step").agg(blocks.alias("by"), F.min("component").alias("ylo"), F.max("component").alias("yhi"))
    # A cell whose rows are all of one component has nothing to find.
    cells = nx.join(ny, ["centre", "step"]).where("lo != hi or ylo != yhi or lo != ylo")
    cells = materialize(cells.select("centre", "step", "bx", "by"), "minhash-cells")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of_x = opened.join(cells, ["centre", "step"]).select("centre", "step", "node", "component", own("bx").alias("x"), all_("by").alias("y"), F.lit(False).alias("asked"))
    of_y = asked.join(cells, ["centre", "step"]).select("centre", "step", "node", "component", all_("bx").alias("x"), own("by").alias("y"), F.lit(True).alias("asked"))
    rows = of_x.unionByName(of_y).join(sets, "node")
    found_ = rows.groupBy("centre", "step", "x", "y").applyInArrow(_block_links(percent), "a long, b long")
    return materialize(found_.select(*_pair(F.col("a"), F.col("b"))).distinct(), "minhash-more")


def components(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, the document itself included. The
    result is a table; what its making wrote is removed.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    prune_joins(spark)
    with scope(spark):
        return hand_over(_components(docs, k, percent, block), "minhash-result")


def _components(docs: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    rows_ = materialize(profile(docs, k, *plan_bands(percent)), "minhash-profile")
    full = rows_.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    same = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by("buckets", "doc_id").alias("buckets")), "minhash-nodes")

    placed = same.select("node", F.explode("buckets").alias("bucket"))
    shared = materialize(placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "minhash-buckets")
    member = materialize(placed.join(shared.where("size > 1"), "bucket"), "minhash-members")

    central = member.groupBy("node").agg(F.sum("size").alias("weight"))
    centre = member.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    centre = materialize(centre, "minhash-centres")
    stars = member.select("bucket", "node").join(centre, "bucket").where("node != centre").select("centre", "node").distinct()
    stars = materialize(stars, "minhash-stars")
    wanted = stars.select(F.explode(F.array("node", "centre")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    wanted = materialize(wanted, "minhash-wanted").where("n > 0")
    sets = materialize(shingle_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), k), "minhash-sets")
    both = stars.join(sets, "node").join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("of_centre")), "centre")
    shared = F.size(F.array_intersect("shingles", "of_centre")).cast("long")
    both = both.select("centre", "node", F.size("shingles").alias("n"), shared.alias("shared"), (F.size("shingles") + F.size("of_centre")).alias("total"))
    # Written before they are grouped: a centre's rows can then be split over tasks.
    both = materialize(both, "minhash-compared")
    # Rows that share a doc_id may give a pair several times; its nearest texts count.
    close = both.groupBy("centre", "node").agg(F.max("n").alias("n"), F.max(F.struct(F.col("shared") / (F.col("total") - F.col("shared")), "shared", "total")).alias("s"))
    united = F.col("s.total") - F.col("s.shared")
    close = close.select("centre", "node", "n", (1 - F.col("s.shared") / united).alias("far"), (100 * F.col("s.shared") >= percent * united).alias("linked"))
    close = materialize(close, "minhash-distances")
    links = close.where("linked").select(*_pair(F.col("centre"), F.col("node")))
    found = connected_components(links, "minhash")
    more = _settle(close.select("centre", "node", "n", "far"), found, sets, percent, block)
    if not more.isEmpty():
        found = connected_components(links.unionByName(more), "minhash-all")

    # Documents of one doc_id with several texts join the nodes of all their texts.
    of_row = full.select("doc_id", "digest").join(same.select("digest", "node"), "digest")
    named = of_row.where("doc_id != node").select(*_pair(F.col("doc_id"), F.col("node"))).distinct()
    several = full.groupBy("doc_id").agg(F.countDistinct("digest").alias("n")).where("n > 1")
    if not several.isEmpty():
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(named), "minhash-named")
    of_node = found.withColumnRenamed("component", "component_id")
    linked = (
        of_row.join(of_node, "node", "left")
        .select("doc_id", F.coalesce("component_id", "node").alias("component_id"))
        .groupBy("doc_id")
        .agg(F.min("component_id").alias("component_id"))
    )
    out = rows_.where(F.col("doc_id").isNotNull()).select("doc_id", "n_shingles").join(linked, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.unionByName(rows_.where(F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the first of their component."""
    judged = components(docs, k, percent)
    drop = judged.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
