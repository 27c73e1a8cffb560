"""Phrases whose words keep company, mined from counts of longest windows.

Every word occurrence has one window: itself and the words that follow it in its piece of text, up to ``longest``, as lead columns
padded where the piece ends. Only these windows are counted. Each shorter phrase is a prefix of the windows that
start where it starts, so Spark's ROLLUP over the lead columns gives the counts of all lengths as sums of the
longest ones; nothing is exploded for each length.

A phrase can be frequent only if each pair of neighbours in it is. So one pass counts pairs in a table of hashed
cells, of a size that follows the corpus up to ``MAX_BITS``; a cell's count is at least that of each pair in it, and a window ends, as
where a piece ends, at a pair whose cell stays below the limit. That loses no frequent phrase and moves few windows; beyond the
table's bound the filter gets weaker, and the counts stay the same. Single words are counted with their spelling in the pass before.

Words travel as 64-bit hashes. The word counts tell whether two spellings of the corpus share a hash; if so, all is done
again with the next salt. Scores are quotients of 38-digit decimals, floored by whole division.

Defined cases: a null text is empty, a null lang is ``und`` (together with texts whose lang is that). Repeated rows and
ids count each. Other columns, doc_id among them, are not looked at. An empty table, or a lang without frequent phrases, gives no rows.
Texts are looked at in slices of 256 KB that end behind a space; a longer run without one is a slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.runtime import bounded_batches, hand_over, materialize, scope

U64 = np.uint64
MINIMUM, LONGEST, TOP = 100, 5, 2000
#: Bytes of texts that a task counts together; cells of the pair table, at least and at most, and in one row of it.
TOGETHER, MIN_BITS, MAX_BITS, CELLS = 4 << 20, 16, 24, 1 << 16
#: Groups in which a language's first phrases are found before they meet.
SPREAD = 64

_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?"]] = 2
_CLASS[0x0A:0x0E] = 2
_BASE = 0xBF58476D1CE4E5B9
_TABLE = np.random.Generator(np.random.PCG64(12)).integers(1, 2**64 - 1, size=256, dtype=np.uint64)


def tokens(blob: bytes, salt: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a lower-cased text: the slice; its words' starts, ends, hashes; and whether each follows the one before it in a piece.

    The first word of a slice is one of the piece before if no end of a piece lies between.
    """
    at, cut = 0, True
    while at < len(blob):
        to = len(blob) if at + W._SLICE >= len(blob) else blob.find(b" ", at + W._SLICE) + 1 or len(blob)
        part = blob[at:to]
        raw = np.frombuffer(part, np.uint8)
        kind = _CLASS[raw]
        word = np.concatenate([[False], kind == 0, [False]])
        starts, ends = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * W.powers(_BASE, len(raw)), out=sums[1:])
        back = W.powers(pow(_BASE, -1, 2**64), len(raw))
        hashes = W.mix(W.mix((sums[ends] - sums[starts]) * back[starts]) ^ U64(salt * 0x9E3779B97F4A7C15 % 2**64))
        np.maximum(hashes, U64(1), out=hashes)  # 0 is the padding
        breaks = np.cumsum(kind == 2)
        if len(starts):
            seen = breaks[starts]
            follows = np.empty(len(starts), bool)
            follows[1:] = seen[1:] == seen[:-1]
            follows[0] = not cut and seen[0] == 0
            cut = breaks[-1] > seen[-1]
            yield part, starts, ends, hashes, follows
        else:
            cut = cut or bool(breaks[-1])
        at = to


def _proof(part: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another hash of the words of a slice, of another kind: of their lengths and sums of their bytes' powers."""
    raw, base = np.frombuffer(part, np.uint8), 0x94D049BB133111EB
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + U64(1)) * W.powers(base, len(raw)), out=sums[1:])
    back = W.powers(pow(base, -1, 2**64), len(raw))
    return W.mix((sums[ends] - sums[starts]) * back[starts]) + (ends - starts).astype(np.uint64)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """lang and its lower-cased texts, about ``TOGETHER`` bytes of all langs at a time; a break between texts."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[tuple[str, bytes]]:
        for lang, texts in held.items():
            yield lang, b"\n ".join(texts).translate(W.LOWER)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), W.utf8(batch.column(1)), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from flush()
                size = 0
    yield from flush()


def _count_words(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, blob in _by_lang(batches):
            spelt: dict[int, bytes] = {}
            every = []
            for part, starts, ends, hashes, _ in tokens(blob, salt):
                own, first, where = np.unique(hashes, return_index=True, return_inverse=True)
                every.append(hashes)
                proof = _proof(part, starts, ends)
                for i in np.flatnonzero(proof != proof[first][where]).tolist():
                    yield _word_rows(lang, [part[starts[i] : ends[i]]], hashes[i : i + 1], np.array([0]))
                for h, a, b in zip(own.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True):
                    if spelt.setdefault(h, part[a:b]) != part[a:b]:  # two spellings, one hash: told apart below
                        yield _word_rows(lang, [part[a:b]], np.array([h], np.uint64), np.array([0]))
            if every:
                own, counts = np.unique(np.concatenate(every), return_counts=True)
                yield _word_rows(lang, [spelt[h] for h in own.tolist()], own, counts)

    return run


def _word_rows(lang: str, spelt: list[bytes], hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(spelt), pa.string()), pa.array(spelt, pa.binary()).cast(pa.string()), pa.array(hashes.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "word", "h", "n"]
    )


def _pairs(lang: str, hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each word and the next one."""
    tongue = U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    return (W.mix(hashes[:-1] * U64(0x9FB21C651E98DF25) + hashes[1:] + tongue) >> U64(64 - bits)).astype(np.int64)


def _words_of(blob: bytes, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and whether each but the first follows the one before in a piece."""
    parts = [(h, f) for _, _, _, h, f in tokens(blob, salt)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, bool)
    return np.concatenate([h for h, _ in parts]), np.concatenate([f for _, f in parts])[1:]


def _count_pairs(salt: int, bits: int, minimum: int):
    """A mapper to rows of cells (chunk, counts); counts from ``minimum`` on are that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for lang, blob in _by_lang(batches):
            hashes, follows = _words_of(blob, salt)
            if len(hashes) > 1:
                cells, n = np.unique(_pairs(lang, hashes, bits)[follows], return_counts=True)
                counts[cells] = np.minimum(counts[cells] + n, minimum)
        yield _chunks(dict(enumerate(counts.astype(_narrow(minimum)).reshape(-1, CELLS))))

    return run


def _narrow(minimum: int) -> type:
    return np.uint8 if minimum < 256 else np.uint16 if minimum < 65536 else np.uint32


def _chunks(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    held = {k: v for k, v in found.items() if v.any()}
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["chunk", "counts"])


def _add_chunks(minimum: int):
    """Adds the rows of each chunk as they come; a partition holds all rows of its chunks. Gives bits of the full cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = total.setdefault(chunk, np.zeros(CELLS, np.uint32))
                np.minimum(own + np.frombuffer(blob, _narrow(minimum)), minimum, out=own)
        yield _chunks({k: np.packbits(v >= minimum) for k, v in total.items()})

    return run


def _windows(salt: int, bits: int, full: np.ndarray, longest: int):
    """A mapper to windows of two words and more, as lead columns w1.., with their counts in this task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, blob in _by_lang(batches):
            hashes, follows = _words_of(blob, salt)
            if len(hashes) < 2:
                continue
            cells = _pairs(lang, hashes, bits)
            linked = np.zeros(len(hashes) + longest, bool)
            linked[: len(cells)] = follows & ((full[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).astype(bool)
            padded = np.concatenate([hashes, np.zeros(longest, np.uint64)])
            at = np.flatnonzero(linked)
            lead, held = [padded[at]], np.ones(len(at), bool)
            for k in range(1, longest):
                held &= linked[at + k - 1]
                lead.append(np.where(held, padded[at + k], U64(0)))
            key = lead[0]
            for column in lead[1:]:
                key = W.mix(key * U64(0x9FB21C651E98DF25) + column)
            _, first, where, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            if any((c != c[first][where]).any() for c in lead):  # two windows with one key: count none of them together
                first, counts = np.arange(len(at)), np.ones(len(at), np.int64)
            columns = [pa.array(c[first].view(np.int64)) for c in lead]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), *columns, pa.array(counts, pa.int64())], names=["lang", *_lead(longest), "n"])

    return run


def _lead(longest: int) -> list[str]:
    return [f"w{k + 1}" for k in range(longest)]


def _word_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """lang, word, h and n of all words, and the salt with which no two spellings share a hash."""
    for salt in range(64):
        counted = texts.mapInArrow(_count_words(salt), "lang string, word string, h long, n long")
        words = materialize(counted.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "phrases-words")
        if words.groupBy("h").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a < b").isEmpty():
            return words, salt
    raise RuntimeError("no salt tells all words apart")


def _full_cells(texts: DataFrame, salt: int, bits: int, minimum: int) -> np.ndarray:
    """Bits of the pair cells that reach ``minimum``: 2 MB at most."""
    full = np.zeros((1 << bits) // 8, np.uint8)
    rows = texts.mapInArrow(_count_pairs(salt, bits, minimum), "chunk long, counts binary")
    rows = rows.repartition((1 << bits) // CELLS, "chunk").mapInArrow(_add_chunks(minimum), "chunk long, counts binary")
    for r in rows.collect():
        full[r.chunk * CELLS // 8 : (r.chunk + 1) * CELLS // 8] = np.frombuffer(r.counts, np.uint8)
    return full


def phrase_counts(windows: DataFrame, minimum: int, longest: int) -> DataFrame:
    """lang, words (hashes) and a of all phrases of two words and more that occur ``minimum`` times: prefixes of the windows."""
    lead = _lead(longest)
    rolled, k = (f", ROLLUP({', '.join(lead[2:])})", f"{longest} - bit_count(grouping_id())") if longest > 2 else ("", "2")
    summed = windows.sparkSession.sql(
        f"SELECT lang, {', '.join(lead)}, sum(n) AS a, {k} AS k FROM {{windows}} GROUP BY lang, w1, w2{rolled} HAVING sum(n) >= {minimum}",
        windows=windows,
    )
    words = F.slice(F.array(*lead), 1, F.col("k").cast("int"))
    return summed.select("lang", words.alias("words"), "a").where(F.element_at("words", -1) != 0)


def _scored(phrases: DataFrame, counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """phrases (lang, words, a) with l, r, n and score of the lowest-scoring cut."""
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("cut")).alias("first"), F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("words").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("words").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(sizes, "lang")
    score = F.expr("(CAST(a AS DECIMAL(19, 0)) * CAST(1000 * n AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    lowest = cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("cut"))
    return lowest.select("lang", "words", "a", "n", "cut.l", "cut.r", "cut.score")


def _inner(phrases: DataFrame) -> DataFrame:
    """The phrases that a phrase of one word more, with as many occurrences, holds.

    A longer one that holds a phrase occurs no more often than any between them, so one word more is enough.
    """
    less = F.size("words") - 1
    both = F.array(F.slice("words", F.lit(1), less), F.slice("words", F.lit(2), less))
    return phrases.where("size(words) > 2").select("lang", F.explode(both).alias("words"), "a").distinct()


def _first(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each lang, with rank: of groups of each language first, so that no task gets all of one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    near = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order))).where(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, minimum: int = MINIMUM, longest: int = LONGEST, top: int = TOP, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's first phrases of ``docs`` (lang, text).

    ``bits`` sets the size of the pair table. The result is a table; what its making wrote is removed.
    """
    if longest < 2 or minimum < 1:
        raise ValueError("phrases have two words and occur once, at least")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    make: Callable[[DataFrame], DataFrame] = lambda out: hand_over(out, "phrases")
    with scope(docs.sparkSession):
        words, salt = _word_counts(texts)
        sizes = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-sizes")
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        bits = bits or min(MAX_BITS, max(MIN_BITS, ceil(log2(total / 16 + 1))))
        full = _full_cells(texts, salt, bits, minimum)
        shape = f"lang string, {', '.join(f'{c} long' for c in _lead(longest))}, n long"
        windows = texts.mapInArrow(_windows(salt, bits, full, longest), shape)
        phrases = materialize(phrase_counts(windows, minimum, longest), "phrases-counts")
        known = materialize(words.where(F.col("n") >= minimum).select("lang", F.array("h").alias("words"), F.col("n").alias("a"), "word"), "phrases-known")
        counts = phrases.unionByName(known.drop("word"))
        scored = _scored(phrases, counts, sizes).join(_inner(phrases), ["lang", "words", "a"], "left_anti")
        scored = materialize(scored, "phrases-scored")
        spelt = scored.select("lang", "words", F.posexplode("words").alias("at", "h")).join(known.select("lang", F.col("words")[0].alias("h"), "word"), ["lang", "h"])
        spelt = spelt.groupBy("lang", "words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelt"))
        spelt = spelt.select("lang", "words", F.array_join("spelt.word", " ").alias("phrase"))
        return make(_first(scored.join(spelt, ["lang", "words"]), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def oracle(minimum: int = MINIMUM, longest: int = LONGEST, top: int = TOP) -> str:
    """SQL of the contract, by counting the phrases of every length."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{up}', '{low}') AS x FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
g AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS p, count(*) AS f
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, {longest + 1}) q(k) WHERE len(ws) >= k) GROUP BY 1, 2, 3),
size AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, p, f AS a, string_split(p, ' ') AS ws FROM g WHERE k > 1 AND f >= {minimum}),
cuts AS (SELECT lang, k, p, a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cuts.*, gl.f AS l, gr.f AS r, n, (1000::HUGEINT * a * n) // (gl.f::HUGEINT * gr.f) AS score
    FROM cuts JOIN g gl ON gl.lang = cuts.lang AND gl.p = x JOIN g gr ON gr.lang = cuts.lang AND gr.p = y JOIN size ON size.lang = cuts.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 100 * b.a AND contains(' ' || c.p || ' ', ' ' || b.p || ' ')))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank, p AS phrase,
    a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept) WHERE rank <= {top}
"""
