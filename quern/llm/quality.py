"""Quality rules over whole texts as one chain of Spark SQL expressions, ordered by a sample.

Each rule is a Boolean expression on counts of the text. The chain is short-circuit: a text
rejected by one rule is not tested by the next. On a bounded sample the share each rule
rejects and the time it takes beyond that of a rule without work are measured, and rules run in order of
rejection per cost; the order changes cost alone, never a verdict. All expressions are built
in, so the whole operator stays in the JVM. ``profile`` returns the counts of every row, so those are always worked out; its
cascade saves the counts that are not returned (letterless and distinct words), which only texts need that no rule before rejects.
In ``accept`` it saves those of all rules that are not reached. Both measure on one table of the sample.

Defined cases: a null text has no words, like an empty one, and so fails ``few_words``. doc_id
may be null or repeated; each row is judged on its own. Lines are equal if all their characters
are. Rules that tie in gain keep their listed order. Other columns are kept by ``accept`` and dropped by
``profile``. A row is judged alone, so memory is bounded by a few arrays of one text's words.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import materialize, scope

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Bounds of the method's own rules; what breaks one is no running text in any language.
MAX_MEAN_WORD = 40
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINE_PERCENT = 60
MIN_DUP_LINES = 10
MAX_LETTERLESS_PERCENT = 70
#: Distinct words are at least half this many times the root of all words; prose of any length has ten times as many.
MIN_DISTINCT_ROOTS = 3
SAMPLE_ROWS = 1000
#: Runs of each rule on the sample; the quickest counts.
REPEATS = 2
#: Seconds below which costs can't be told apart.
LEAST_COST = 1e-3
_WS = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _given(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once and bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _WS), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), _BLANKS, "")).cast("long")


def symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long")


def letterless_words(text: Column) -> Column:
    """Words without a letter, in one pass of a pattern that never goes back."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.translate(s, _BLANKS, "") != "")


def duplicate_lines(text: Column) -> Column:
    return _given(_lines(text), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def _covered(windows: Column) -> Column:
    """Words in windows that occur again. ``windows`` is sorted by hash, then place."""
    n = F.size(windows)

    def again(w: Column, i: Column) -> Column:
        before = (i > 0) & (F.get(windows, i - 1)["h"] == w["h"])
        return before | ((i < n - 1) & (F.get(windows, i + 1)["h"] == w["h"]))

    places = F.sort_array(F.transform(F.filter(windows, again), lambda w: w["i"]))
    # Places in order: each adds the words that the one before doesn't cover.
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("at"))
    return F.aggregate(
        places,
        start,
        lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(3), i - acc["at"])).alias("sum"), i.alias("at")),
        lambda acc: acc["sum"],
    )


def repeated_words(words_: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, the first included."""

    def of(ws: Column) -> Column:
        # Each word is hashed once; windows are hashes of three of these.
        of_words = F.transform(ws, lambda w: F.xxhash64(w))
        hashes = _given(of_words, lambda h: F.transform(F.slice(h, 1, F.size(h) - 2), lambda a, i: F.xxhash64(a, F.get(h, i + 1), F.get(h, i + 2))))
        twice = _given(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(_sorted(hs)))
        return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(twice)

    def _sorted(hs: Column) -> Column:
        return _given(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), _covered)

    return _given(words_, of)


class Rule(NamedTuple):
    """A named test that is true of texts to reject, of a text's counts by name."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


def rules() -> list[Rule]:
    """The two base rules and the method's own."""
    return [
        Rule("few_words", lambda c: c["n_words"] < MIN_WORDS),
        Rule("repeats", lambda c: 100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]),
        Rule("long_words", lambda c: c["word_chars"] > MAX_MEAN_WORD * c["n_words"]),
        Rule("symbols", lambda c: 100 * c["n_symbols"] > MAX_SYMBOL_PERCENT * c["word_chars"]),
        Rule("duplicate_lines", lambda c: (c["n_dup_lines"] >= MIN_DUP_LINES) & (100 * c["n_dup_lines"] > MAX_DUP_LINE_PERCENT * c["n_lines"])),
        Rule("letterless", lambda c: 100 * c["n_letterless"] > MAX_LETTERLESS_PERCENT * c["n_words"]),
        Rule("few_distinct", lambda c: 4 * c["n_distinct"] * c["n_distinct"] < MIN_DISTINCT_ROOTS**2 * c["n_words"]),
    ]


BASE = ("few_words", "repeats")


def counts(text: Column, words_: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words_).cast("long"),
        "word_chars": word_chars(text),
        "n_symbols": symbols(text),
        "n_lines": F.size(_lines(text)).cast("long"),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(words_),
    } | _lazy(text, words_)


def _lazy(text: Column, words_: Column) -> dict[str, Column]:
    """Counts that ``profile`` doesn't return."""
    return {"n_letterless": letterless_words(text), "n_distinct": F.size(F.array_distinct(words_)).cast("long")}


def _passes(text: Column, ordered: list[Rule]) -> Column:
    """True where no rule rejects. Words are split once; a rule's counts are worked out only if those before it let pass."""

    def all_of(ws: Column) -> Column:
        known = counts(text, ws)
        out = F.lit(True)
        for rule in ordered:
            out = out & ~rule.fails(known)
        return out

    return _given(words(text), all_of)


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows: of a seeded share of large tables, so that few more than these meet in one task."""
    n = docs.count()
    return (docs.sample(4 * rows / n, seed=10) if n > 4 * rows else docs).limit(rows)


def _measured(verdicts: list[Column], idle: Column, sample: DataFrame) -> list[float]:
    """Rejections per second of each verdict on the rows of ``sample``: its cost is the time beyond that of an idle one."""

    def seconds(hit: Column) -> float:
        times = []
        for _ in range(REPEATS):
            began = time.monotonic()
            sample.select(F.count(F.when(hit, 1))).collect()
            times.append(time.monotonic() - began)
        return min(times)

    shares = sample.select(*(F.avg(v.cast("double")) for v in verdicts)).first()
    least = seconds(idle)
    return [(share or 0.0) / max(seconds(v) - least, LEAST_COST) for share, v in zip(shares, verdicts, strict=True)]


def _ordered(gains: list[float]) -> list[Rule]:
    listed = rules()
    return [listed[i] for i in sorted(range(len(listed)), key=lambda i: (-gains[i], i))]


def order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, measured on at most ``sample_rows`` rows, each with the counts that it needs."""
    with scope(docs.sparkSession):
        sample = materialize(_sample(docs.select(F.col("text").cast("string").alias("text")), sample_rows), "quality-sample")
        text = F.col("text")
        return _ordered(_measured([~_passes(text, [rule]) for rule in rules()], F.octet_length(text) < 0, sample))


def cascade(ordered: list[Rule], known: dict[str, Column]) -> Column:
    """Name of the first rule in order that rejects, null if none does."""
    out = F.when(ordered[0].fails(known), F.lit(ordered[0].name))
    for rule in ordered[1:]:
        out = out.when(rule.fails(known), F.lit(rule.name))
    return out


def _counted(docs: DataFrame) -> DataFrame:
    """doc_id, text and the counts that are returned, of every row. Words and lines are split once for all counts that need them."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    one = F.col("text")
    of_words = _given(words(one), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words")))
    of_lines = _given(_lines(one), lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))
    rows = rows.select("doc_id", "text", of_words.alias("w"), of_lines.alias("s"), word_chars(one).alias("word_chars"), symbols(one).alias("n_symbols"))
    return rows.select("doc_id", "text", "w.n_words", "word_chars", "n_symbols", F.col("s.dup").alias("n_dup_lines"), "w.n_repeat_words", F.col("s.n").alias("n_lines"))


def profile(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The counts of every row of ``docs`` (doc_id, text), base_failed, kept and the rule that rejects."""
    rows = _counted(docs)
    known = {c: F.col(c) for c in rows.columns} | _lazy(F.col("text"), words(F.col("text")))
    with scope(docs.sparkSession):
        # Counts that every row has anyway cost a rule nothing, so the sample has them.
        sample = materialize(_counted(_sample(docs.select("doc_id", "text"), sample_rows)), "quality-sample")
        ordered = _ordered(_measured([rule.fails(known) for rule in rules()], F.col("n_words") < 0, sample))
    rows = rows.withColumn("rejected_by", cascade(ordered, known))
    failed = F.lit(False)
    for rule in rules():
        failed = failed | rule.fails(known) if rule.name in BASE else failed
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by",
    )


def accept(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    return docs.where(_passes(F.col("text").cast("string"), order(docs, sample_rows)))
