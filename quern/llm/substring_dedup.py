"""Removal of passages that an earlier document has, found by difference-cover anchors.

A difference cover D modulo v has, for any two positions i and j, a step s < v with i + s and
j + s both in D modulo v. So if windows of ``size`` words at i and j are equal, the runs of
``size - v + 1`` words at i + s and j + s are equal anchors, both at cover positions. Hashing
runs at cover positions alone (|D| of v) therefore finds every repeated window: a window can
only repeat if it holds an anchor that another document has too. Around such anchors the match is
extended, by comparing the full windows that hold them, with 128-bit hashes, to the smallest
document each one starts in.

Counts and minima are partial aggregates before the shuffle, and are written before they are
joined back: both sides of that equi-join are then plain shuffles, so adaptive execution can split
the rows of a passage that a third of all documents share, and they are
never gathered in one place; what is collected for a document is bounded by its own words.

Defined cases: a null text has no words, like an empty one. Repeats inside one document alone
are kept. Rows without a doc_id come before nothing and after nothing: their words stay and
remove no others. Rows that share a doc_id are judged each on its own against smaller
doc_ids. Other columns are not looked at. A window's first document is the one with the smallest
doc_id; rows that tie remove nothing from each other. Batches hold about ``BATCH_BYTES`` of texts, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.runtime import bounded_batches, hand_over, materialize, prune_joins, scope

#: A perfect difference set modulo 31: every residue is a difference of two of these.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def _runs(texts: list[bytes | None], make: W.Windows) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each text its window hashes by start, for each salt."""
    for a, b in W.groups(texts):
        hashes, at = W.hash_words(texts[a:b])
        all_ = make(hashes)
        for i in range(b - a):
            lo, hi = at[i], max(at[i], at[i + 1] - make.size + 1)
            yield a + i, [h[lo:hi] for h in all_]


def _flat(ids: pa.Array, counts: list[int]) -> pa.Array:
    """Each id as often as its count says."""
    return ids.take(pa.array(np.repeat(np.arange(len(counts)), counts)))


def _join(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def anchors(docs: DataFrame, size: int) -> DataFrame:
    """anchor (hash), content, doc_id and pos of the anchors at each text's cover positions.

    ``docs`` has doc_id, content (a hash of the whole text) and text.
    """
    make = W.Windows(size - PERIOD + 1, (11,))
    chosen = np.zeros(PERIOD, dtype=bool)
    chosen[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, places, counts = [], [], []
            for _, (h,) in _runs(W.utf8(batch.column(2)), make):
                # Documents too short for one window hold nothing that could be removed or matched.
                at = np.flatnonzero(chosen[np.arange(len(h)) % PERIOD]) if len(h) >= PERIOD else np.empty(0, np.int64)
                hashes.append(h[at])
                places.append(at.astype(np.int32))
                counts.append(len(at))
            own = [_flat(batch.column(i), counts) for i in (1, 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_join(hashes, np.uint64).view(np.int64)), *own, pa.array(_join(places, np.int32))],
                names=["anchor", "content", "doc_id", "pos"],
            )

    return docs.select("doc_id", "content", "text").mapInArrow(run, "anchor long, content long, doc_id long, pos int")


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """w1, w2 (128-bit hash), doc_id and pos of every window that holds a listed anchor.

    ``docs`` has doc_id, text and places (array of anchor positions).
    """
    make = W.Windows(size, (12, 13))
    back = PERIOD - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(2)
            one, two, places, counts = [], [], [], []
            for i, (h1, h2) in _runs(W.utf8(batch.column(1)), make):
                held = np.zeros(len(h1) + 1, np.int64)
                pos = np.asarray(listed[i].values, dtype=np.int64)
                # A window at s holds the anchor at p if p - back <= s <= p.
                np.add.at(held, np.clip(pos - back, 0, len(h1)), 1)
                np.add.at(held, np.clip(pos + 1, 0, len(h1)), -1)
                at = np.flatnonzero(np.cumsum(held[:-1]) > 0)
                one.append(h1[at])
                two.append(h2[at])
                places.append(at.astype(np.int32))
                counts.append(len(at))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_join(one, np.uint64).view(np.int64)),
                    pa.array(_join(two, np.uint64).view(np.int64)),
                    _flat(batch.column(0), counts),
                    pa.array(_join(places, np.int32)),
                ],
                names=["w1", "w2", "doc_id", "pos"],
            )

    return docs.mapInArrow(run, "w1 long, w2 long, doc_id long, pos int")


def _copies(docs: DataFrame) -> DataFrame:
    """doc_id, content and key (MD5 of the text) of each row whose whole text an earlier document has."""
    keyed = docs.select("doc_id", "content", F.md5(F.col("text").cast("binary")).alias("key"))
    same = keyed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    same = materialize(same, "cover-same").where("lo < hi")
    return keyed.join(same, "key").where("doc_id > lo").select("doc_id", "content", "key").distinct()


def repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """What is repeated, by doc_id of ``docs`` (doc_id, text): windows and copies.

    ``windows`` lists start and hash of each window that also starts in a document with a smaller
    doc_id; ``copies`` the keys of those of its texts that such a document has whole, whose
    windows needn't be looked at one by one. The result is a table; what its making wrote is removed.
    """
    if size < PERIOD + 1:
        raise ValueError(f"a window needs more than {PERIOD} words")
    prune_joins(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    with scope(docs.sparkSession):
        return hand_over(_repeats(docs, size), "cover-repeats")


def _repeats(docs: DataFrame, size: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    docs = docs.withColumn("content", F.xxhash64("text"))
    copies = materialize(_copies(docs), "cover-copies")
    found = anchors(docs, size)
    # Anchors of one text and its copies alone are no sign of a passage.
    shared = found.groupBy("anchor").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo < hi")
    # The test is repeated behind the table: it lets Spark take the side for a filter of the other.
    shared = materialize(shared, "cover-shared").where("lo < hi").select("anchor")
    places = found.select("anchor", "content", "doc_id", "pos").join(shared, "anchor")
    places = materialize(places.groupBy("doc_id", "content").agg(F.collect_set("pos").alias("places")), "cover-anchors")
    places = materialize(places.join(copies, ["doc_id", "content"], "left_anti"), "cover-places").where(F.size("places") > 0)
    windows = _windows(docs.join(places, ["doc_id", "content"]).select("doc_id", "text", "places"), size)
    early = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    early = materialize(early, "cover-early").where("lo < hi").select("w1", "w2", "lo")
    late = windows.join(early, ["w1", "w2"]).where("doc_id > lo").select("doc_id", "pos", "w1")
    # The hash tells apart rows that share a doc_id but not a text.
    late = late.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "w1")).alias("windows"))
    late = materialize(late, "cover-windows").select("doc_id", "windows", F.lit(None).cast("string").alias("key"))
    whole = copies.select("doc_id", F.lit(None).cast(late.schema["windows"].dataType).alias("windows"), "key")
    both = late.unionByName(whole)
    return both.groupBy("doc_id").agg(F.flatten(F.collect_list("windows")).alias("windows"), F.collect_set("key").alias("copies"))


def _strip(size: int):
    """A mapper of (doc_id, text, windows, copies) to the kept words and counts."""
    make = W.Windows(size, (12,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            texts = W.utf8(batch.column(1))
            for i, (windows, copies) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                own = left = (texts[i] or b"").split()
                if len(own) < size:
                    pass
                elif copies and hashlib.md5(texts[i]).hexdigest() in copies:
                    left = []
                elif windows.is_valid and len(windows):
                    pos = np.asarray(windows.values.field("pos"), dtype=np.int64)
                    seen = np.asarray(windows.values.field("w1"), dtype=np.int64)
                    ((_, (h,)),) = _runs([texts[i]], make)
                    ok = pos < len(h)
                    pos, seen = pos[ok], seen[ok]
                    pos = pos[h[pos].view(np.int64) == seen]
                    cover = np.zeros(len(own) + 1, np.int64)
                    np.add.at(cover, pos, 1)
                    np.add.at(cover, pos + size, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    left = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                total.append(len(own))
                removed.append(len(own) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def dedup(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by a space) of every row."""
    late = repeats(docs, size)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(late, "doc_id", "left").select("doc_id", "text", "windows", "copies").mapInArrow(
        _strip(size), "doc_id long, n_words long, n_removed long, kept_text string"
    )
