"""A trigram index for searches by substring: posting lists of the rarest pieces, and the exact test behind them.

The index is a table of posting lists by segment: a task reads texts up to ``SEGMENT_BYTES`` at a time and writes a row for each gram in
them, with the keys of the texts that hold it and their number. So nothing is shuffled, and the index is made in one pass, in memory that a segment bounds.
Rows lie in buckets of grams and are sorted within. A search looks up its tokens' grams, takes the rarest few of each token, and reads their
postings alone: other buckets are pruned as partitions, other grams by the statistics of pages. Texts of candidates are then tested as a scan would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import bounded_batches, shared_path

SIZE, BUCKETS, RAREST = 3, 64, 2
#: Bytes of UTF-8 in a segment, about; a longer text is a segment of its own.
SEGMENT_BYTES = 1 << 22
_BITS = 21  # of a code point; SIZE of them fit a long


def _code(gram: str) -> int:
    """A gram as one number, by which it is stored and looked up."""
    n = 0
    for c in gram:
        n = n << _BITS | ord(c)
    return n


def _bucket(codes: np.ndarray | int) -> np.ndarray | int:
    """Sums of a gram's characters, weighted so that its own order counts."""
    low = (1 << _BITS) - 1
    return ((codes & low) * 7 + (codes >> _BITS & low) * 3 + (codes >> 2 * _BITS)) % BUCKETS


def _codes(text: str) -> np.ndarray:
    """The distinct grams of a text, ascending."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    if len(c) < SIZE:
        return np.empty(0, np.int64)
    code = np.zeros(len(c) - SIZE + 1, np.int64)
    for k in range(SIZE):
        code = code << _BITS | c[k : len(c) - SIZE + 1 + k]
    code.sort()
    return code[np.concatenate([[True], code[1:] != code[:-1]])]


def _lists(keys: list[pa.Array], texts: list[pa.Array]) -> pa.RecordBatch:
    """The posting lists of a segment, by bucket and gram."""
    held = [_codes(t) for part in texts for t in part.to_pylist()]
    gram = np.concatenate([*held, np.empty(0, np.int64)])
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)).astype(np.int32)), pa.concat_arrays(keys).take(pa.array(row)))
    codes = gram[first]
    batch = pa.RecordBatch.from_arrays([pa.array(_bucket(codes).astype(np.int32)), pa.array(codes), lists, pa.array(np.diff(np.append(first, len(gram))))], names=["bucket", "gram", "keys", "n"])
    return batch.take(pa.array(np.lexsort((codes, _bucket(codes)))))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, texts, size = [], [], 0
    for batch in batches:
        keys.append(batch.column(0))
        texts.append(batch.column(1))
        size += batch.column(1).nbytes
        if size >= SEGMENT_BYTES:
            yield _lists(keys, texts)
            keys, texts, size = [], [], 0
    if keys:
        yield _lists(keys, texts)


class TextIndex:
    """An index over the ``text`` column of a table with a unique ``key``; ``path`` is in the shared folder if not given."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "text-index")

    def build(self, table: DataFrame, key: str, text: str) -> TextIndex:
        """Write the posting lists. Null texts have no grams and are never found."""
        bounded_batches(self.spark)
        rows = table.select(F.col(key).alias("key"), F.lower(text).alias("text")).where("text is not null")
        kind = rows.schema["key"].dataType.simpleString()
        lists = rows.mapInArrow(_segments, f"bucket int, gram long, keys array<{kind}>, n long")
        lists.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        return self

    def postings(self) -> DataFrame:
        """bucket, gram, keys of a segment that hold it, and their number n."""
        return self.spark.read.parquet(f"{self.path}/postings")

    def _chosen(self, tokens: list[str]) -> tuple[list[int], bool]:
        """The rarest grams of every token; and whether some gram is in no text."""
        wanted = {t: [_code(t[i : i + SIZE]) for i in range(len(t) - SIZE + 1)] for t in tokens}
        every = sorted({g for gs in wanted.values() for g in gs})
        if not every:
            return [], False
        known = self._where(every).groupBy("gram").agg(F.sum("n").alias("n"))
        n = {r.gram: r.n for r in known.collect()}  # a row for each gram of the query
        if any(g not in n for g in every):
            return [], True
        return sorted({g for gs in wanted.values() for g in sorted(set(gs), key=lambda g: (n[g], g))[:RAREST]}), False

    def _where(self, wanted: list[int]) -> DataFrame:
        return self.postings().where(F.col("bucket").isin(sorted({_bucket(g) for g in wanted})) & F.col("gram").isin(wanted))

    def candidates(self, tokens: list[str]) -> DataFrame | None:
        """``key`` of texts that hold the rarest grams of every token; None if no token is long enough to look up."""
        chosen, missing = self._chosen([t.lower() for t in tokens])
        if missing:
            return self.postings().select(F.explode("keys").alias("key")).limit(0)
        if not chosen:
            return None
        held = self._where(chosen).select(F.explode("keys").alias("key"))
        return held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(chosen)).select("key")

    def search(self, table: DataFrame, key: str, text: str, tokens: list[str]) -> DataFrame:
        """The rows of ``table`` whose lower-cased text holds every token: the same as a scan, by fewer texts."""
        near = self.candidates(tokens)
        rows = table if near is None else table.join(near.withColumnRenamed("key", key), key, "left_semi")
        for t in tokens:
            rows = rows.where(F.contains(F.lower(F.col(text)), F.lit(t.lower())))
        return rows

    def top(self, table: DataFrame, key: str, text: str, words: list[str], limit: int) -> DataFrame:
        """``key`` and score of the rows that hold the most of ``words``; a row that holds none is in no word's candidates."""
        lists = [self.candidates([w]) for w in words]
        rows = table
        if all(c is not None for c in lists):
            near = lists[0]
            for more in lists[1:]:
                near = near.unionByName(more)
            rows = table.join(near.distinct().withColumnRenamed("key", key), key, "left_semi")
        total = F.lit(0)
        for w in words:
            total = total + F.contains(F.lower(F.col(text)), F.lit(w.lower())).cast("int")
        return rows.select(key, total.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)
