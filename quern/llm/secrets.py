"""Secrets in texts: fixed patterns, and strings that two Markov models call random.

The patterns are the base: assignments to names like ``password``, access keys and long runs of
hex digits. Besides, every run of key-like characters is scored under two character Markov models
of first order, one of random strings and one of ordinary words and identifiers, both trained
from labelled samples; a run whose mean log-likelihood ratio is high enough, and that mixes
letters and digits, is a span of kind ``random`` unless a base span covers part of it.

Labelled samples: random strings are drawn over the alphabets that keys use, by a seeded
generator, so that all executors agree. Ordinary ones are taken from the ``SAMPLE_TEXTS`` rows of the
corpus whose doc_ids have the smallest hashes (the bound of this fit, whatever the files' layout), as they are and joined
into identifiers in the usual styles. Runs that the base patterns match are left out of them.

Defined cases: a null text has no spans, like an empty one. Offsets count code points, ends are
exclusive. Spans of one kind never overlap. doc_id may be null or repeated; each row stands for
itself. An empty corpus leaves a model that was trained on built-in identifiers alone. Of rows that
tie in the sample (one doc_id), those with the smaller texts are taken. Extra columns are kept by ``redact`` and
dropped by ``find``. The work on a text is in proportion to its length but for sorting its spans; a
batch holds about ``BATCH_BYTES`` of texts, or one longer text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import bounded_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this drops exactly the shorter ones
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Texts of the labelled sample of ordinary words, at most.
SAMPLE_TEXTS = 2048
RANDOM_STRINGS = 20_000
#: Mean log-likelihood ratio (nats a character) from which a run counts as random.
THRESHOLD = 1.0
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (_DIGITS + "abcdef", _DIGITS + _LOWER, _DIGITS + _LOWER.upper(), _DIGITS + _LOWER + _LOWER.upper(), _DIGITS + _LOWER + _LOWER.upper() + "+/")
IDENTIFIERS = (
    "get_default_value HttpRequestHandler max_retry_count userAccountManager config-file-path content_type_2 utf8_decode FactoryBean2 "
    "createSessionToken parseInputStream database_connection_pool background-color first_name lastModifiedTimestamp IllegalArgumentException "
    "org-springframework-context window-scroll-position EventListener1 test_case_12 backup2024 index-page-3 application_settings version_10_3"
).split()
#: Times that each built-in identifier counts.
BUILT_IN = 20


def _base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans in order."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    folded = text.lower()
    if "password" in folded or "passwd" in folded or "secret" in folded or "token" in folded or "api" in folded:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(out)


def pair_counts(samples: list[str]) -> np.ndarray:
    """How often each ASCII character follows each other one; 0 stands for a string's start."""
    codes = np.frombuffer("".join("\x00" + s for s in samples).encode("ascii", "ignore"), dtype=np.uint8).astype(np.int64)
    pairs = codes[:-1] * 128 + codes[1:]
    return np.bincount(pairs[codes[1:] != 0], minlength=128 * 128)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of a character after another, with add-one smoothing."""
    table = counts.reshape(128, 128) + 1.0
    return np.log(table / table.sum(axis=1, keepdims=True))


def random_samples(n: int = RANDOM_STRINGS, seed: int = 5) -> list[str]:
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for i in range(n):
        alphabet = np.array(list(ALPHABETS[i % len(ALPHABETS)]))
        out.append("".join(alphabet[rng.integers(0, len(alphabet), int(rng.integers(20, 64)))]))
    return out


def ordinary_samples(text: str) -> list[str]:
    """Words of a text that no base pattern matches, plain and joined into identifiers."""
    plain = CANDIDATE.sub(" ", ASSIGN.sub(" ", HEX.sub(" ", ACCESS.sub(" ", text))))
    words = re.findall(r"[A-Za-z0-9_-]{2,}", plain)
    out = list(words)
    for i in range(0, len(words) - 2, 3):
        a, b, c = words[i : i + 3]
        out.append(f"{a}_{b}_{c}".lower() if i % 2 else a.lower() + b.capitalize() + c.capitalize())
    return out


def sample(docs: DataFrame, texts: int) -> DataFrame:
    """The text of the ``texts`` rows with the smallest hashes of doc_id and text; of all rows, if there are no more.

    Equal hashes are equal rows (or, hardly ever, others), so any of them may stand for the rest. Hashes are counted below a bound that lets
    some four times as many rows through; only where repeated rows leave too few there are all hashes counted, which then are few. At most
    ``texts`` hashes reach the driver, and the texts themselves are filtered where they are.
    """
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("hash"), F.col("text").cast("string").alias("text"))
    n = rows.count()
    if n <= texts:
        return rows.select("text")

    def least(some: DataFrame) -> tuple[int, int] | None:
        """The last hash that is needed and how many of its rows, if ``some`` has enough."""
        left = texts
        for r in some.groupBy("hash").count().orderBy("hash").limit(texts).collect():
            if r["count"] >= left:
                return r["hash"], left
            left -= r["count"]
        return None

    share = 4 * texts / n
    last, ties = (share < 1 and least(rows.where(F.col("hash") < int((share - 0.5) * 2**64)))) or least(rows)
    return rows.where(F.col("hash") < last).unionByName(rows.where(F.col("hash") == last).limit(ties)).select("text")


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> np.ndarray:
    """Log-likelihood ratios by pair of characters, from labelled samples (see above)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(128 * 128, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += pair_counts(ordinary_samples(text or ""))
        yield pa.RecordBatch.from_pydict({"n": pa.array([total])})

    bounded_batches(docs.sparkSession)
    ordinary = pair_counts(IDENTIFIERS * BUILT_IN)
    for (n,) in sample(docs, sample_texts).mapInArrow(run, "n array<long>").collect():
        ordinary += np.array(n, dtype=np.int64)
    return log_model(pair_counts(random_samples())) - log_model(ordinary)


def _spans(text: str, ratio: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans; the method's own are those that touch no base span."""
    base = _base(text)
    starts = [s for s, _, _ in base]
    reach = [0, *accumulate((e for _, _, e in base), max)]
    out = list(base)
    for m in CANDIDATE.finditer(text):
        run, a, b = m.group(), m.start(), m.end()
        # What starts before the run's end must not reach beyond its start.
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and reach[bisect_left(starts, b)] <= a:
            codes = np.frombuffer(("\x00" + run).encode(), dtype=np.uint8)
            if ratio[codes[:-1], codes[1:]].mean() >= THRESHOLD:
                out.append((a, 3, b))
    return sorted(out)


def listing(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, the base spans' listing, that of all spans, and a count of each base kind."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_spans(t or "", ratio) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(3)]
            base = pa.array([listing([s for s in f if s[1] < 3]) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, base, pa.array(map(listing, found), pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string"
    )


def scan(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs``."""
    return find(docs, train(docs, sample_texts)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def blank(text: str | None, ratio: np.ndarray) -> str | None:
    """``text`` with every span replaced by its kind in brackets; overlapping spans go as one."""
    out, at = [], 0
    for a, k, b in _spans(text or "", ratio):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``docs`` with the secrets in text blanked and n_chars, where there is one, made to fit."""
    bounded_batches(docs.sparkSession)
    ratio = train(docs, sample_texts)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([blank(t, ratio) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), clean)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
