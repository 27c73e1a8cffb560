"""Benchmark items in documents, re-parameterised ones included, by template windows.

Texts are canonicalised to templates: the letters and digits of words, lower-cased, with numbers, names
(capitalised words inside a sentence, runs of them as one) and units (behind a number)
replaced by typed placeholders, whose words are kept as slots. A second kind of template takes names for
literal words, so it is the same whatever the case of the text. Windows of ``WINDOW`` template words
of the documents are hash-joined with those of the items, each kind with its own. An item's windows that line up with a
document along one diagonal are one alignment, in which slots must be consistent: one and the
same word of the item must always face one and the same word of the document; different words of the item may
face the same one, as redrawn values often coincide. A breach costs only the windows that
hold the word, and none whose slots are the item's own. A document holds an item if the windows left
cover at least ``MIN_PERCENT`` of the item's windows: of one kind, or of both together, where windows
that start at one word of the item count once.

Before the join, windows are tested against a bitmap of the items' hashes of fixed size
(``BITMAP_BITS``, made by a distributed ``bit_or``), the only thing that is shipped to all
tasks; however many items there are, it stays as large, and only false hits grow.

A window that many items and many documents hold would join all of them with each other. So items and documents meet at rare windows first: of an
item's windows, by how often documents hold them, all but the ``percent`` most frequent ones, and one of these. A document
that holds the item holds one of those at least. Only the pairs that met are aligned, by all their windows.

Defined cases: null and empty texts, of items and documents, hold nothing, and so do texts without a
letter or digit. Items of fewer words than a window are one window of their own length; those of fewer than
``MIN_WORDS`` words, too short for a template, must stand in the document word for word. Windows of too few
literal words are left out, unless an item has no others. Repeated items and documents give repeated alignments and
one result for each pair of ids; an item_id or doc_id with several texts holds what any of them does, by the longest of
the item's texts. A document is returned with every item it holds, so ties need no choice. Rows without a doc_id or
item_id are ignored. Other columns are kept by ``clean`` and never looked at. Batches hold about ``BATCH_BYTES`` of
texts, or one longer text; an alignment is gathered in one task and holds at most the windows of one item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.words import U64, groups, mix, powers
from quern.runtime import bounded_batches, hand_over, materialize, scope

WINDOW = 5
MIN_WORDS = 3
MIN_LITERALS = 3
MIN_PERCENT = 50
BITMAP_BITS = 1 << 23
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months "
    "year years percent % kmh mph km/h m/s hz khz mhz ghz w kw mw v kv a j kj cal kcal n pa kpa bar k °c °f c f usd eur gbp dollars euros pounds cents "
    "meters metres kilometers kilometres grams kilograms liters litres miles feet inches".split()
)
_LITERAL, _NUM, _NONE = 0, 1, -1
_NAME_HASH, _NUM_HASH, _UNIT_HASH = U64(0x1A2B), U64(0x3C4D), U64(0x5E6F)
_BASE = 0xD6E8FEB86659FD93
#: Properties of the code points of most texts; those beyond are looked up one by one.
_TOP = 0x3000
_CHARS = [chr(c) for c in range(_TOP)]
_SPACES = np.array([c.isspace() for c in _CHARS])
_ALNUM = np.array([c.isalnum() for c in _CHARS])
_DIGIT = np.array([c.isdigit() for c in _CHARS])
_UPPER = np.array([c.isupper() for c in _CHARS])
_LOWER = np.array([ord(low) if len(low := c.lower()) == 1 and ord(low) < _TOP else ord(c) for c in _CHARS], dtype=np.uint32)
_ENDS = np.isin(np.arange(_TOP), [ord(c) for c in ".!?:;…"])
_VALUE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64 - 1, size=_TOP, dtype=np.uint64)


def _properties(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Space, letter or digit, digit, upper case, sentence end, and a random value of the lower-cased character."""
    rare = codes >= _TOP
    if not rare.any():
        return _SPACES[codes], _ALNUM[codes], _DIGIT[codes], _UPPER[codes], _ENDS[codes], _VALUE[_LOWER[codes]]
    near = np.where(rare, 0, codes)
    kinds, which = np.unique(codes[rare], return_inverse=True)
    chars = [chr(c) for c in kinds.tolist()]
    own = [np.array([f(c) for c in chars]) for f in (str.isspace, str.isalnum, str.isdigit, str.isupper, lambda c: c in "。！？")]
    out = [t[near] for t in (_SPACES, _ALNUM, _DIGIT, _UPPER, _ENDS)]
    for full, part in zip(out, own, strict=True):
        full[rare] = part[which]
    value = _VALUE[_LOWER[near]]
    low = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], dtype=np.uint64)
    value[rare] = mix(low + U64(1))[which]
    return (*out, value)


def _core(raw: str) -> str:
    return "".join(c for c in raw if c.isalnum()).lower()


class Templates:
    """Both templates of several texts, one text after the other: with names as placeholders, and as literals."""

    def __init__(self, texts: list[str | None]):
        self.text = " ".join([t or "" for t in texts]) + " "
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        space, alnum, digit, upper, ends, value = _properties(codes)
        first = ~space
        first[1:] &= space[:-1]
        self.starts = at = np.flatnonzero(first)
        if not len(at):
            self.kinds = [_Template(self, np.empty(0, np.uint64), np.empty(0, bool), at, at)] * 2
            return
        # How many letters or digits of its word stand before each character.
        before = np.cumsum(alnum) - alnum
        within = np.zeros(len(codes), np.int64)
        within[at[0] :] = before[at[0] :] - np.repeat(before[at], np.diff(np.append(at, len(codes))))
        value[~alnum] = 0
        value *= powers(_BASE, int(within.max()) + 1)[within]
        total = lambda flags: np.add.reduceat(flags, at, dtype=np.int64)
        place = np.arange(len(codes))
        latest = lambda flags: np.maximum.reduceat(np.where(flags, place, -1), at)
        letters, digits, capitals = total(alnum), total(digit), total(upper)
        leading = total(upper & alnum & (within == 0)) > 0
        hashed = mix(np.add.reduceat(value, at))
        kind = np.where(letters == 0, _NONE, np.where(digits == letters, _NUM, _LITERAL))
        sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
        owner = np.searchsorted(np.cumsum(sizes), at, side="right")
        closed = np.concatenate([[True], (latest(ends) > latest(alnum))[:-1] | (owner[1:] != owner[:-1])])
        name = leading & (capitals == 1) & (letters > 1) & ~closed
        unit = np.concatenate([[False], (kind[:-1] == _NUM) & (owner[1:] == owner[:-1])]) & np.isin(hashed, _UNIT_HASHES)
        name &= ~unit
        words = kind != _NONE
        keep = words.copy()
        keep[1:] &= ~(name[1:] & name[:-1])
        number = kind == _NUM
        hashed[number], hashed[unit] = _NUM_HASH, _UNIT_HASH
        made = lambda h, slot, kept: _Template(self, mix(h[kept]), slot[kept], owner[kept], np.flatnonzero(kept))
        self.kinds = [made(np.where(name, _NAME_HASH, hashed), number | name | unit, keep), made(hashed, number | unit, words)]


class _Template:
    """``hashes`` has a hash of each word, ``slot`` marks placeholders, ``owner`` is the text each is of, ``places`` its place among all words."""

    def __init__(self, texts: Templates, hashes: np.ndarray, slot: np.ndarray, owner: np.ndarray, places: np.ndarray):
        self.text, self.starts = texts.text, texts.starts
        self.hashes, self.slot, self.owner, self.places = hashes, slot, owner, places

    def slots(self, at: int, size: int) -> list[str]:
        """The words in the placeholders of the window at ``at``."""
        out = []
        for i in range(at, at + size):
            if self.slot[i]:
                k = self.places[i]
                end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
                out.append(_core(self.text[self.starts[k] : end]))
        return out

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of ``size`` that lie in one text."""
        rolled = _rolling(self.hashes, size)
        at = np.flatnonzero(self.owner[: len(rolled)] == self.owner[size - 1 :]) if len(rolled) else np.empty(0, np.int64)
        return at, rolled[at]


def _rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_BASE, len(hashes)), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * powers(pow(_BASE, -1, 2**64), n) + U64(size))


def _literals(marks: np.ndarray, size: int) -> np.ndarray:
    """Literal words in each window."""
    sums = np.concatenate([[0], np.cumsum(~marks)])
    return sums[size:] - sums[:-size]


def _word_hash(word: str) -> np.uint64:
    letters = np.array([c for c in map(ord, _core(word))], dtype=np.int64)
    values = np.array([_VALUE[_LOWER[c]] if c < _TOP else mix(np.array([c + 1], np.uint64))[0] for c in letters], np.uint64)
    return mix(np.array([(values * powers(_BASE, len(letters))).sum(dtype=np.uint64)], np.uint64))[0]


_UNIT_HASHES = np.array(sorted(_word_hash(u) for u in UNITS if _core(u)), dtype=np.uint64)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """kind, window (hash), size, item_id, idx, place, slots, total of the kind and of both, of the items' template windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = []
                for kind, made in enumerate(Templates([text]).kinds):
                    size = min(window, len(made.hashes))
                    if not size:
                        continue
                    rolled = made.windows(size)[1].view(np.int64)
                    plain = _literals(made.slot, size) >= min(MIN_LITERALS, size)
                    at = np.flatnonzero(plain) if plain.any() else np.arange(len(plain))
                    found += [(kind, int(rolled[i]), size, item, int(i), int(made.places[i]), made.slots(i, size), len(at)) for i in at]
                both = len({f[5] for f in found})
                rows += [(*f, both) for f in found]
            names = ["kind", "window", "size", "item_id", "idx", "place", "item_slots", "total", "both"]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32()]
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null")
    return rows.mapInArrow(run, "kind int, window long, size int, item_id long, idx int, place int, item_slots array<string>, total int, both int")


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """One bit for each hash, packed; at most ``bits`` / 32 words are gathered."""
    place = F.pmod(F.col("window"), F.lit(bits))
    words = windows.select(F.shiftright(place, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(window, {bits}) % 32 as int))").alias("bit"))
    out = np.zeros(bits // 32, np.uint32)
    for word, value in words.groupBy("word").agg(F.expr("bit_or(bit)")).collect():
        out[word] = value
    return out.view(np.uint8)


def _repeated(words: str) -> Column:
    """The words that stand more than once in an array."""
    return F.expr(f"array_distinct(filter(array_sort({words}), (w, i) -> i >= 1 and w = array_sort({words})[i - 1]))")


_KEY = ["kind", "window", "size"]


def rare_windows(listed: DataFrame, hits: DataFrame, percent: int) -> DataFrame:
    """kind, window, size and item_id of windows of ``listed`` one of which every document that holds the item must have.

    A document needs ``percent`` of an item's places, of a kind or of both. Of n places of which m are needed, any n - m + 1 hold one of
    those; the least frequent ones are taken, windows that no document has first of all.
    """
    often = materialize(hits.groupBy(*_KEY).agg(F.count("*").alias("n")), "template-often")
    known = listed.select(*_KEY, "item_id", "place", "total", "both").join(often, _KEY, "left").na.fill(0, ["n"])
    known = materialize(known, "template-known")
    found = None
    for by, total in ((["item_id", "kind"], "total"), (["item_id"], "both")):
        places = known.groupBy(*by, "place").agg(F.sum("n").alias("n"), F.max(total).alias("total"))
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("n", "place"))
        whole = Window.partitionBy(*by)
        need = F.greatest(F.ceil(F.lit(percent) * F.max("total").over(whole) / 100), F.lit(1))
        first = places.select(*by, "place", "n", (rank <= F.count("*").over(whole) - need + 1).alias("first")).where("first and n > 0")
        part = known.join(first.select(*by, "place"), [*by, "place"], "left_semi").where("n > 0").select(*_KEY, "item_id")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = MIN_PERCENT, bits: int = BITMAP_BITS) -> DataFrame:
    """doc_id, item_id, n_windows of the item, n_matched, and whether the slots differ (reworded). A table; what its making wrote is removed."""
    bounded_batches(docs.sparkSession)
    with scope(docs.sparkSession):
        return hand_over(_matches(docs, items, window, percent, bits), "template-matches")


def _matches(docs: DataFrame, items: DataFrame, window: int, percent: int, bits: int) -> DataFrame:
    listed = materialize(item_windows(items, window), "template-items")
    packed = _bitmap(listed, bits)
    sizes = sorted(map(tuple, listed.select("kind", "size").distinct().collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(packed, bitorder="little").view(bool)
        for batch in batches:
            rows, ids = [], batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                both = Templates(texts[a:b])
                for kind, size in sizes:
                    made = both.kinds[kind]
                    at, rolled = made.windows(size)
                    rolled = rolled.view(np.int64)
                    seen = set()
                    for i in np.flatnonzero(bitmap[rolled % bits]).tolist():
                        k = int(at[i])
                        row = (kind, int(rolled[i]), size, ids[a + int(made.owner[k])], k, made.slots(k, size))
                        if size < MIN_WORDS:
                            # One place tells as much as all others with the same words.
                            told = (*row[1:4], *row[5])
                            if told in seen:
                                continue
                            seen.add(told)
                        rows.append(row)
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "window", "size", "doc_id", "pos", "doc_slots"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    hits = rows.mapInArrow(run, "kind int, window long, size int, doc_id long, pos int, doc_slots array<string>")
    hits = materialize(hits, "template-hits")
    met = hits.select(*_KEY, "doc_id").join(materialize(rare_windows(listed, hits, percent), "template-rare"), _KEY).select("doc_id", "item_id").distinct()
    aligned = materialize(met, "template-met").join(listed, "item_id").join(hits, ["doc_id", *_KEY])
    aligned = aligned.withColumn("pairs", F.arrays_zip("item_slots", "doc_slots"))
    along = aligned.groupBy("doc_id", "item_id", "kind", (F.col("pos") - F.col("idx")).alias("diagonal"))
    along = along.agg(F.collect_set(F.struct("place", "pairs")).alias("windows"), F.max("total").alias("total"), F.max("both").alias("both"), F.max("size").alias("size"))
    along = along.withColumn("pairs", F.array_distinct(F.flatten("windows.pairs"))).withColumn("split", _repeated("pairs.item_slots"))
    same = lambda w: F.forall(w["pairs"], lambda p: p["item_slots"] == p["doc_slots"])
    whole = lambda w: ~F.arrays_overlap(w["pairs"]["item_slots"], "split") & (F.col("size") >= MIN_WORDS)
    counted = F.filter("windows", lambda w: same(w) | whole(w))
    differ = F.exists("pairs", lambda p: p["item_slots"] != p["doc_slots"])
    whole = along.select("doc_id", "item_id", "kind", "total", "both", differ.alias("differ"), F.explode(counted["place"]).alias("place"))
    of = lambda kind, column: F.when(F.col("kind") == kind, F.col(column))
    share = lambda n, m: F.struct((F.size(F.collect_set(m)) / F.max(n)).alias("share"), F.max(n).cast("long").alias("n"), F.size(F.collect_set(m)).cast("long").alias("m"))
    shares = F.array(share(F.col("both"), F.col("place")), *(share(of(k, "total"), of(k, "place")) for k in (0, 1)))
    # A slot differs if a kind has no alignment without a difference: names differ in the first kind alone.
    reworded = F.greatest(*(F.min(of(k, "differ")) for k in (0, 1)))
    found = whole.groupBy("doc_id", "item_id").agg(F.array_max(shares).alias("best"), reworded.alias("reworded"))
    found = found.select("doc_id", "item_id", F.col("best.n").alias("n_windows"), F.col("best.m").alias("n_matched"), "reworded")
    return found.where(100 * F.col("n_matched") >= percent * F.col("n_windows"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item; rows without a doc_id stay."""
    bad = materialize(matches(docs, items).select("doc_id").distinct(), "template-found")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
