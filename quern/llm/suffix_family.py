"""Removal of byte strings that occur more than once, found by a logarithmic family of suffix arrays.

The index is a family of levels. While two levels are of one size (in batches), they are merged to one of twice the size. Then a
new batch of texts gets a suffix array of its own, which is merge-scanned against the levels that are there for matches
of ``size`` bytes, and becomes a level. So b batches leave log2(b) levels and one more at most, and an entry is rewritten log2(b) times.

The arrays are sparse. Of each window of ``size`` bytes, the leftmost of its runs of k bytes (two fifths of it) with the smallest hash is a
sampled suffix, so what is sampled in a window depends on its bytes alone: equal windows have sampled suffixes at the same place, and two
in a hundred bytes are sampled. A level holds its suffixes by the hash of their first k bytes, each with a 128-bit hash of its
surroundings (all bytes of the windows that hold it); suffixes with equal surroundings are one entry with their number,
so a passage that a third of the texts share is a few entries. Equal surroundings settle a suffix: each of its windows is repeated. What is left are
suffixes that share their first bytes and differ around: the ends of matches. Their bytes are fetched, sorted forwards and backwards
from the suffix (a suffix and a prefix array with the lengths that neighbours have in common), and for each offset s a window is repeated if two
entries agree on s bytes before and size - s bytes from the suffix on: ranges of both arrays tell. A group of more than ``GROUP`` different
entries is split first: by halves of the offsets, and by hashes of the longer bytes that all windows of a half share,
down to single offsets, where equal hashes (128 bits) are the match. So no task gathers more of a group, and nothing is capped.

Texts are known by 128-bit hashes, so rows need no id: repeated rows, and rows without doc_id, are occurrences like all others. All
intermediate tables are written in the shared folder, so a lost executor costs its tasks only.

Defined cases: a null text is empty, and nothing of texts below ``size`` bytes is removed. Matches inside one text count, overlaps included.
An empty table gives no rows. Other columns are not looked at. A text is looked at in slices of 1 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.runtime import bounded_batches, hand_over, materialize, prune_joins, remove, scope

U64 = np.uint64
SIZE, BATCHES = 200, 3
#: Entries of a group that one task compares; entries that it compares together.
GROUP, TOGETHER = 4096, 16384
_SLICE = 1 << 20
#: A window's smallest hash is told by its upper 40 bits; the lower ones hold the place, so that the leftmost one wins.
_PLACE = U64((1 << 24) - 1)
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_TABLE = np.random.Generator(np.random.PCG64(13)).integers(1, 2**64 - 1, size=(2, 256), dtype=np.uint64)


class _Sums:
    """Hashes of any run of bytes, by sums of powers; one for each base."""

    _known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, raw: np.ndarray, which: int):
        base, n = _BASES[which], len(raw)
        held = self._known.get(which)
        if held is None or len(held[0]) <= n:
            n_ = max(2 * n, 1 << 18)
            held = self._known[which] = (W.powers(base, n_), W.powers(pow(base, -1, 2**64), n_))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[which][raw] * held[0][:n], out=self.sums[1:])
        self.back = held[1]

    def rolling(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return W.mix((self.sums[k:] - self.sums[:n]) * self.back[:n])

    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return W.mix((self.sums[b] - self.sums[a]) * self.back[a])


def sampled(hashes: np.ndarray, starts: np.ndarray, wide: int) -> np.ndarray:
    """Places of the leftmost smallest of ``wide`` hashes from each of ``starts``."""
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: span - wide], least[wide - span :])
    found = np.zeros(len(hashes), bool)
    found[(least[starts] & _PLACE).astype(np.int64)] = True
    return np.flatnonzero(found)


def _pieces(texts: list[bytes | None], size: int) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int, int, int]]]]:
    """Blobs to look at: the bytes, where windows start, and (text, its begin and end in the blob, place of the blob's begin in it)."""
    for a, b in W.groups(texts):
        if b - a == 1 and len(texts[a] or b"") > _SLICE:
            text = texts[a]
            for at in range(0, len(text) - size + 1, _SLICE):
                lo, hi = max(0, at - size), min(len(text), at + _SLICE + 2 * size)
                yield text[lo:hi], np.arange(at, min(at + _SLICE, len(text) - size + 1)) - lo, [(a, 0, hi - lo, lo)]
            continue
        at, starts, held = 0, [], []
        for i in range(a, b):
            n = len(texts[i] or b"")
            if n >= size:
                starts.append(np.arange(at, at + n - size + 1))
                held.append((i, at, at + n, 0))
                at += n
        if held:
            yield b"".join(texts[i] for i, *_ in held), np.concatenate(starts), held


def suffixes(texts: DataFrame, size: int) -> DataFrame:
    """key, c1, c2, d1, d2, pos, before and after of the sampled suffixes of ``texts`` (d1, d2, text).

    ``before`` and ``after`` are the lengths of the surroundings on either side of pos, c1 and c2 their hash.
    """
    k = max(1, 2 * size // 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.empty((0, 7), np.int64)]
            last = (-1, -1)
            for blob, starts, held in _pieces(W.utf8(batch.column(2)), size):
                raw = np.frombuffer(blob, np.uint8)
                one, two = _Sums(raw, 0), _Sums(raw, 1)
                keys = one.rolling(k)
                at = sampled(keys, starts, size - k + 1)
                text, begin, end, shift = (np.array(x) for x in zip(*held, strict=True))
                of = np.searchsorted(begin, at, side="right") - 1
                if len(held) == 1 and last[0] == text[0]:  # the slice before may have given this one
                    new = at + shift[0] > last[1]
                    at, of = at[new], of[new]
                a, b = np.maximum(begin[of], at - (size - k)), np.minimum(end[of], at + size)
                shape = ((at - a) * 1000003 + (b - at)).astype(np.uint64)
                around = [W.mix(s.runs(a, b) + shape * U64(0x9FB21C651E98DF25)).view(np.int64) for s in (one, two)]
                rows.append(np.stack([keys[at].view(np.int64), *around, text[of], at - begin[of] + shift[of], at - a, b - at], axis=1))
                if len(at):
                    last = (int(text[of[-1]]), int(at[-1] - begin[of[-1]] + shift[of[-1]]))
            key, c1, c2, of, pos, before, after = np.concatenate(rows).T
            d1, d2 = (batch.column(i).take(pa.array(of)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key, c1, c2)), d1, d2, *(pa.array(x) for x in (pos, before, after))], names=_FIELDS)

    return texts.select("d1", "d2", "text").mapInArrow(run, ", ".join(f"{f} long" for f in _FIELDS))


_FIELDS = ["key", "c1", "c2", "d1", "d2", "pos", "before", "after"]
_PLACED = ["d1", "d2", "pos", "before", "after"]


def _surroundings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around each of ``wanted`` (key, d1, d2, pos, before, after, open), from ``texts``."""
    lists = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct("key", "pos", "before", "after", "open")).alias("listed"))
    found = texts.join(materialize(lists, "family-wanted"), ["d1", "d2"]).select("d1", "d2", "text", "listed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(W.utf8(batch.column(2))):
                listed = batch.column(3)[i].values
                key, pos, before, after, open_ = (listed.field(f) for f in ("key", "pos", "before", "after", "open"))
                around = [text[p - b : p + a] for p, b, a in zip(pos.to_pylist(), before.to_pylist(), after.to_pylist(), strict=True)]
                same = [batch.column(j).take(pa.array(np.full(len(around), i))) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([key, *same, pos, before, pa.array(around, pa.binary()), open_], names=["g", "d1", "d2", "pos", "before", "around", "open"])

    found = found.mapInArrow(run, "g long, d1 long, d2 long, pos long, before long, around binary, open boolean")
    # A text with copies is met once for each; partial aggregates drop them before the shuffle.
    return found.dropDuplicates(["g", "d1", "d2", "pos"])


def _bytes(flat: np.ndarray, at: np.ndarray, held: np.ndarray, step: int, wide: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of group, then of the bytes at ``at``, ``at + step``.. (``held`` of them); and what each has in common with the row before."""
    places = at[:, None] + step * np.arange(wide)
    inside = np.arange(wide) < held[:, None]
    rows = np.zeros((len(at), 8 + wide), np.uint8)
    rows[:, :8] = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8:][inside] = flat[places[inside]]
    order = np.argsort(rows.view(f"S{8 + wide}").ravel(), kind="stable")
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), 8 + wide) - 8
    held = held[order]
    return order, np.concatenate([[-1], np.minimum(common, np.minimum(held[1:], held[:-1]))])


def repeated(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: np.ndarray, around: list[bytes], size: int) -> np.ndarray:
    """For each entry and offset s, whether the window that starts s bytes before it is also around another entry of its group.

    Offsets from ``lo`` to ``hi`` (excluded) are asked for; ``before`` is where the entry is in ``around``.
    """
    flat = np.frombuffer(b"".join(around) or b"\0", np.uint8)
    length = np.array([len(x) for x in around])
    begin = np.cumsum(length) - length
    _, group = np.unique(group, return_inverse=True)
    after, most = length - before, int(hi.max())
    forth, same_forth = _bytes(flat, begin + before, after, 1, size, group)
    back, same_back = _bytes(flat, begin + before - 1, before, -1, max(most - 1, 1), group)
    found = np.zeros((len(around), most), bool)
    one, two = np.empty(len(around), np.int64), np.empty(len(around), np.int64)
    for s in range(int(lo.min()), most):
        rows = np.flatnonzero((lo <= s) & (s < hi) & (before >= s) & (after >= size - s))
        if len(rows) < 2:
            continue
        one[forth] = np.cumsum(same_forth < size - s)
        two[back] = np.cumsum(same_back < s)
        _, which, count = np.unique(one[rows] * (len(around) + 1) + two[rows], return_inverse=True, return_counts=True)
        found[rows, s] = count[which] > 1
    return found


def _compare(size: int):
    """A mapper of entries, sorted by group, to the covered runs (d1, d2, a, b) of the open ones."""

    def runs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        group, lo, hi, before, pos = (t.column(c).to_numpy() for c in ("g", "lo", "hi", "before", "pos"))
        open_ = t.column("open").to_numpy()
        found = repeated(group, lo, hi, before, t.column("around").to_pylist(), size)
        edge = np.diff(np.pad(found[open_], ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, past = np.nonzero(edge == -1)
        row = np.flatnonzero(open_)[row]
        d1, d2 = (t.column(c).take(pa.array(row)).combine_chunks() for c in ("d1", "d2"))
        return pa.RecordBatch.from_arrays([d1, d2, pa.array(pos[row] - past + 1), pa.array(pos[row] - first + size)], names=["d1", "d2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows >= TOGETHER:  # up to where a group begins
                group = batch.column(0).to_numpy()
                other = np.flatnonzero(group != held[-1].column(0)[-1].as_py())
                if len(other):
                    cut = int(other[0])
                    yield runs([*held, batch.slice(0, cut)] if cut else held)
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield runs(held)

    return run


def _split(entries: DataFrame, size: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Entries whose groups have ``most`` at most, and the runs found where groups came down to one offset."""
    small, single = [], []
    while True:
        sizes = entries.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most)
        hot = materialize(sizes.select("g"), "family-hot")
        if hot.isEmpty():
            break
        small.append(entries.join(hot, "g", "left_anti"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        halves = F.explode(F.array(F.struct(F.col("lo").alias("x"), middle.alias("y")), F.struct(middle.alias("x"), F.col("hi").alias("y"))))
        parts = entries.join(hot, "g").withColumn("half", halves).withColumn("lo", F.col("half.x")).withColumn("hi", F.col("half.y")).drop("half")
        # The bytes that all windows of these offsets share.
        start, wide = F.col("before") - F.col("lo"), F.lit(size + 1) - F.col("hi") + F.col("lo")
        parts = parts.where((start >= 0) & (F.octet_length("around") >= start + wide))
        core = F.substring("around", (start + 1).cast("int"), wide.cast("int"))
        parts = materialize(parts.withColumn("core", F.md5(core)).withColumn("g", F.xxhash64("g", "lo", "hi", "core")), "family-halves")
        ends = parts.where("hi - lo = 1")
        twice = materialize(ends.groupBy("g", "core").agg(F.count("*").alias("n")), "family-ends").where("n > 1")
        single.append(ends.join(twice, ["g", "core"]).where("open").select("d1", "d2", (F.col("pos") - F.col("lo")).alias("a"), (F.col("pos") - F.col("lo") + size).alias("b")))
        entries = parts.where("hi - lo > 1").drop("core")
    for part in small:
        entries = entries.unionByName(part)
    return entries, single


class SuffixFamily:
    """Levels of suffix arrays over the batches of texts added so far, and the repeated runs found between them.

    A text is (d1, d2, text) as ``identified`` makes it. Copies of a text must come in one batch.
    """

    def __init__(self, spark: SparkSession, size: int = SIZE, group: int = GROUP):
        if size < 2:
            raise ValueError("a match has two bytes at least")
        self.spark, self.size, self.group = spark, size, group
        self.levels: list[tuple[int, DataFrame]] = []
        self.texts: DataFrame | None = None
        self.runs: list[DataFrame] = []

    def add(self, texts: DataFrame, known: DataFrame | None = None) -> None:
        """Scan a batch against itself and all levels, then let it be a level.

        ``known`` are the texts added so far with these, where the caller has a plan that reads them at once.
        """
        self.merge()
        self.texts = known if known is not None else texts if self.texts is None else self.texts.unionByName(texts)
        with scope(self.spark):
            fresh = materialize(suffixes(texts.where(F.octet_length("text") >= self.size), self.size), "family-suffixes")
            array = fresh.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in _PLACED))
            array = hand_over(array.sortWithinPartitions("key", "c1", "c2"), "family-level")
            self._scan(fresh, array)
        self.levels.append((1, array))

    def merge(self) -> None:
        """Merge levels while the last two are of one size; ``add`` does so before a batch comes."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, b), (_, a) = self.levels.pop(), self.levels.pop()
            merged = a.unionByName(b).groupBy("key", "c1", "c2").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in _PLACED))
            self.levels.append((2 * n, materialize(merged.sortWithinPartitions("key", "c1", "c2"), "family-level")))
            for old in (a, b):
                _drop(old)

    def _scan(self, fresh: DataFrame, array: DataFrame) -> None:
        both = array.withColumn("new", F.lit(True))
        for _, level in self.levels:
            both = both.unionByName(level.withColumn("new", F.lit(False)))
        # Only first bytes that two entries share, one of them new, can give a match between entries.
        shared = both.groupBy("key").agg(F.count("*").alias("m"), F.max("new").alias("any_new")).where("m > 1 and any_new").select("key")
        shared = materialize(shared, "family-shared")
        alone = ~F.col("new") & (F.col("n") == 1)
        both = both.join(shared, "key", "left_semi").groupBy("key", "c1", "c2").agg(
            F.sum("n").alias("n"), F.max("new").alias("new"), *(F.first(c).alias(c) for c in _PLACED), *(F.first(F.when(alone, F.col(c)), ignorenulls=True).alias(f"old_{c}") for c in _PLACED)
        )
        both = materialize(both, "family-scan")
        settled = both.where("new and n > 1").select("key", "c1", "c2").unionByName(array.where("n > 1").select("key", "c1", "c2"))
        run = [(F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after")).alias("b")]
        mine = fresh.join(settled, ["key", "c1", "c2"]).select("d1", "d2", *run)
        theirs = both.where("new and n > 1 and old_d1 is not null").select(*(F.col(f"old_{c}").alias(c) for c in _PLACED)).select("d1", "d2", *run)
        self.runs.append(hand_over(mine.unionByName(theirs).distinct(), "family-settled"))
        mixed = both.groupBy("key").agg(F.count("*").alias("m"), F.max("new").alias("any_new"), F.min("n").alias("least"))
        mixed = materialize(mixed.where("m > 1 and any_new and least = 1").select("key"), "family-mixed")
        wanted = both.join(mixed, "key").select("key", *_PLACED, (F.col("n") == 1).alias("open"))
        last = self.size - max(1, 2 * self.size // 5) + 1
        entries = _surroundings(self.texts, wanted).withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(last).cast("long")})
        entries, single = _split(materialize(entries, "family-entries"), self.size, self.group)
        order = ["g", "d1", "d2", "pos", "before", "around", "open", "lo", "hi"]
        found = entries.select(*order).repartition("g").sortWithinPartitions("g").mapInArrow(_compare(self.size), "d1 long, d2 long, a long, b long")
        for part in single:
            found = found.unionByName(part)
        self.runs.append(hand_over(found, "family-runs"))

    def covered(self) -> DataFrame:
        """d1, d2 and the runs (a, b) of bytes of each text that are covered by a repeated string; runs may overlap."""
        every = self.runs[0]
        for more in self.runs[1:]:
            every = every.unionByName(more)
        return every.groupBy("d1", "d2").agg(F.collect_set(F.struct("a", "b")).alias("runs"))


def _drop(table: DataFrame) -> None:
    """Remove the folder of a table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        remove(table.sparkSession, folder)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and its hashes d1 and d2."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", text).select("doc_id", "text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), "text").alias("d2"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, spans, kept = [], [], [], []
        for text, runs in zip(W.utf8(batch.column(1)), batch.column(2), strict=True):
            total.append(len(text))
            if not runs.is_valid:
                removed.append(0)
                spans.append(0)
                kept.append(text)
                continue
            cover = np.zeros(len(text) + 1, np.int64)
            np.add.at(cover, runs.values.field("a").to_numpy(), 1)
            np.add.at(cover, runs.values.field("b").to_numpy(), -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (total, removed, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def dedup(docs: DataFrame, size: int = SIZE, batches: int = BATCHES, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row, with texts added in ``batches`` by their hash."""
    spark = docs.sparkSession
    prune_joins(spark)
    bounded_batches(spark)
    docs = identified(docs)
    with scope(spark):
        family = SuffixFamily(spark, size, group)
        for i in range(batches):
            turn = F.pmod("d1", F.lit(batches))
            family.add(docs.where(turn == i).select("d1", "d2", "text"), docs.where(turn <= i).select("d1", "d2", "text"))
        covered = hand_over(family.covered(), "family-covered")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(covered, ["d1", "d2"], "left").select("doc_id", "text", "runs").mapInArrow(_strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def oracle(size: int = SIZE) -> str:
    """SQL of the contract, by counting every window; bytes are pairs of hex digits."""
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * size})) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {size - 1})) AS i FROM d WHERE len(h) >= {2 * size})),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {size} THEN 0 ELSE 1 END AS begins FROM hit),
spans AS (SELECT r, min(i) AS a, max(i) + {size} AS b FROM (SELECT r, i, sum(begins) OVER (PARTITION BY r ORDER BY i) AS s FROM g) GROUP BY r, s),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans),
cut AS (SELECT gaps.r, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS x, max(b) AS e, sum(b - a) AS removed, count(*) AS n FROM gaps JOIN d USING (r) GROUP BY 1)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
    sha256(unhex(coalesce(x || substr(h, 2 * e + 1), h))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
