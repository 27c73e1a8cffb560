"""Languages of documents by inferring, for each, the mixture of languages it is written in.

Training counts character n-grams (1 to 4 characters, lower-cased, with the word's edges) by
language over all labelled documents; n-grams are hashed to ``BUCKETS`` cells, so the model's size
is bounded by languages x cells whatever the corpus holds. A word's likelihood under a language is the
product of its n-grams' smoothed probabilities. A document is a mixture: each word comes from
one of its languages, and expectation-maximisation estimates the proportions. The set of languages
is built up from the best single one: the next language is admitted while the gain in log-likelihood
exceeds its penalty, which grows with the logarithm of the number of words. The prediction is the
admitted language with the largest proportion, and the score is that proportion.

Defined cases: a text that is null or has no letter is ``und`` with score 0. Without any labelled document
all are. Of equal proportions the alphabetically first language wins. Labelled rows may be
repeated; each counts. lang, source and doc_id never enter a prediction. At most
``MAX_LANGUAGES`` languages are learned; more raise an error. doc_id may be null (then no row is held out) or
repeated; each row stands for itself. Other columns are not looked at. A batch holds about ``BATCH_BYTES`` of
texts, or one longer text; the arrays of a text grow with its words times the languages. The model, of at
most ``BUCKETS`` x ``MAX_LANGUAGES`` numbers, is all that is gathered and shipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import U64, groups, mix, utf8
from quern.runtime import bounded_batches, materialize, scope

BUCKETS = 1 << 15
MAX_LANGUAGES = 256
SMOOTHING = 0.5
ROUNDS = 12
#: Log-likelihood, as a multiple of log(words), that one more language must gain.
PENALTY = 3.0
#: N-grams within a word aren't independent; their log-likelihoods are tempered by this.
TEMPER = 0.25
_N = (1, 2, 3, 4)


def _ngrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the word of each, and where each text's words begin.

    A word is a run of letters; every letter gives the n-grams that end there and lie in the
    word with a space in front of it.
    """
    decoded = " ".join([""] + [(t or b"").decode().lower() + " " for t in texts])
    codes = np.frombuffer(decoded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters(codes)
    first = letters.copy()
    first[1:] &= ~letters[:-1]
    word = np.cumsum(first) - 1
    at = np.flatnonzero(letters)
    code = np.where(letters, codes, np.uint32(32)).astype(np.uint64)
    grams, owners = [], []
    hashed = np.zeros(len(at), np.uint64)
    inside = np.ones(len(at), bool)
    for n in _N:
        back = np.maximum(at - (n - 1), 0)
        hashed = mix(hashed * U64(0x9FB21C651E98DF25) + code[back] + U64(n))
        if n > 2:
            inside &= letters[np.maximum(at - (n - 2), 0)]
        grams.append(hashed[inside] % U64(BUCKETS))
        owners.append(word[at[inside]])
    starts = np.flatnonzero(first)
    sizes = np.fromiter((len((t or b"").decode().lower()) + 2 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return np.concatenate(grams).astype(np.int64), np.concatenate(owners), np.searchsorted(starts, bounds)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters; only those that occur are looked up."""
    kinds, which = np.unique(codes, return_inverse=True) if codes.max(initial=0) >= 0x3000 else (None, None)
    if kinds is None:
        return _LOW[codes]
    return np.array([chr(c).isalpha() for c in kinds.tolist()], dtype=bool)[which]


_LOW = np.array([chr(c).isalpha() for c in range(0x3000)], dtype=bool)


def count(docs: DataFrame) -> DataFrame:
    """lang, bucket and n over all rows of ``docs`` (text, lang) that have a lang.

    A language whose texts have no letter has one row, of n 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            texts = utf8(batch.column(0))
            for lang in set(langs):
                own = [t for t, g in zip(texts, langs, strict=True) if g == lang]
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for a, b in groups(own):
                    total += np.bincount(_ngrams(own[a:b])[0], minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total) if total.any() else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at), "n": pa.array(total[at])})

    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null")
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order, and log-probabilities by bucket and language."""
    bounded_batches(docs.sparkSession)
    with scope(docs.sparkSession):
        # Counted once; the table is at most cells x languages rows.
        counted = materialize(count(docs), "language-counts")
        langs = sorted(r[0] for r in counted.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
        if len(langs) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        found = counted.toArrow()
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    if langs:
        place = pc.index_in(found["lang"], value_set=pa.array(langs, pa.string()))
        table[found["bucket"].to_numpy(), place.to_numpy()] += found["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32) if langs else table


def _em(like: np.ndarray, at: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document, over its active languages.

    ``like`` has a row of likelihoods for each word, ``at`` where each document's words begin.
    """
    sizes = np.diff(np.append(at, len(like)))
    mass = active / active.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        joint = like * np.repeat(mass, sizes, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        mass = np.add.reduceat(joint, at, axis=0) / sizes[:, None]
    total = (like * np.repeat(mass, sizes, axis=0)).sum(axis=1)
    return mass, np.add.reduceat(np.log(np.maximum(total, 1e-300)), at)


def mixtures(texts: list[bytes | None], table: np.ndarray) -> np.ndarray:
    """Proportions of each text's languages, all 0 where it has no letter."""
    out = np.zeros((len(texts), table.shape[1]))
    if not table.shape[1]:
        return out
    for a, b in groups(texts, 1 << 18):
        grams, owners, bounds = _ngrams(texts[a:b])
        if not len(grams):
            continue
        words = bounds[-1]
        score = np.empty((words, table.shape[1]), np.float64)
        for j in range(table.shape[1]):
            score[:, j] = np.bincount(owners, weights=table[grams, j], minlength=words)
        score *= TEMPER
        like = np.exp(score - score.max(axis=1, keepdims=True))
        sizes = np.diff(bounds)
        docs = np.flatnonzero(sizes)
        out[a + docs] = _select(like, bounds[docs], sizes[docs])
    return out


def _select(like: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Forward choice of each document's languages under the penalty."""
    n, kinds = len(at), like.shape[1]
    single = np.add.reduceat(np.log(np.maximum(like, 1e-300)), at, axis=0)
    active = np.zeros((n, kinds), bool)
    active[np.arange(n), single.argmax(axis=1)] = True
    best, mass = single.max(axis=1), active.astype(float)
    full = _em(like, at, np.ones((n, kinds), bool))[0]
    cost = PENALTY * np.log(sizes + 1)
    open_ = np.arange(n)
    while len(open_) and active.sum(axis=1).max() < kinds:
        open_ = open_[active[open_].sum(axis=1) < kinds]
        trial = active[open_].copy()
        trial[np.arange(len(open_)), np.where(trial, -1, full[open_]).argmax(axis=1)] = True
        # No gain can exceed what is missing to the words' own best likelihoods, which are 1.
        hope = -best[open_] > cost[open_]
        open_, trial = open_[hope], trial[hope]
        if not len(open_):
            break
        rows = np.concatenate([np.arange(at[i], at[i] + sizes[i]) for i in open_])
        starts = np.cumsum(sizes[open_]) - sizes[open_]
        got, log = _em(like[rows], starts, trial)
        better = log - best[open_] > cost[open_]
        open_ = open_[better]
        active[open_], best[open_], mass[open_] = trial[better], log[better], got[better]
    return mass


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mass = mixtures(utf8(batch.column(1)), shipped.value)
            top = mass.argmax(axis=1) if langs else np.zeros(len(mass), int)
            scores = mass.max(axis=1, initial=0.0)
            named = [langs[i] if s > 0 else "und" for i, s in zip(top.tolist(), scores.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(named, pa.string()), pa.array(np.minimum(scores, 1.0))], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out_predictions(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Predictions for all of ``docs``, learned from the rows outside one fold of crc32(doc_id)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % folds == fold, F.lit(False))
    langs, table = train(docs.where(~held))
    out = predict(docs, langs, table)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
