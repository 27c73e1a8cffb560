"""Vectorised hashing of white-space separated words, shared by the shingle and window operators.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``; as these are
ASCII, the words of a UTF-8 text are the same by bytes as by characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64 - 1, size=256, dtype=np.uint64)
_TABLE[SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _slices(blob: bytes) -> Iterator[tuple[int, int]]:
    """Pieces of about 256 KB that end behind a space, so that no word is cut."""
    at, end = 0, len(blob)
    while at < end:
        to = at + _SLICE
        if to < end:
            to = blob.find(b" ", to) + 1 or end
        yield at, min(to, end)
        at = min(to, end)


def hash_words(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` one after the other, and where each text's begin.

    The second array has one more entry than ``texts``. A null text has no words.
    """
    blob = b" ".join([t or b"" for t in texts]) + b" "
    if lower:
        blob = blob.translate(LOWER)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
    hashes, starts = [], []
    for a, b in _slices(blob):
        raw = np.frombuffer(blob, dtype=np.uint8, count=b - a, offset=a)
        space = SPACE[raw]
        first = ~space
        first[1:] &= space[:-1]
        at = np.flatnonzero(first)
        if not len(at):
            continue
        within = np.arange(b - a, dtype=np.int64)[at[0] :]
        within -= np.repeat(at, np.diff(np.append(at, b - a)))
        value = _TABLE[raw[at[0] :]]
        longest = int(within[~space[at[0] :]].max()) + 1
        np.minimum(within, longest - 1, out=within)
        value *= powers(_BASE, longest)[within]
        hashes.append(mix(np.add.reduceat(value, at - at[0])))
        starts.append(at + a)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    where = np.concatenate(starts)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return np.concatenate(hashes), np.searchsorted(where, bounds)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` words; with fewer words, of the whole sequence."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = mix(out * U64(0x9FB21C651E98DF25) + words[j : len(words) - k + 1 + j])
    return out


class Windows:
    """Rolling hashes of every window of ``size`` words, one for each of ``salts``."""

    def __init__(self, size: int, salts: tuple[int, ...]):
        self.size, self.salts = size, salts
        self.bases = [(s * 2 + 1) * 0xD1342543DE82EF95 % 2**64 | 1 for s in salts]

    def __call__(self, words: np.ndarray) -> list[np.ndarray]:
        n = len(words) - self.size + 1
        if n <= 0:
            return [np.empty(0, np.uint64) for _ in self.salts]
        out = []
        for salt, base in zip(self.salts, self.bases, strict=True):
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(mix(words ^ U64(salt)) * powers(base, len(words)), out=sums[1:])
            out.append(mix((sums[self.size :] - sums[:n]) * powers(pow(base, -1, 2**64), n)))
        return out


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as bytes."""
    return column.cast(pa.binary()).to_pylist()


def groups(texts: list[bytes | None], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` bytes; a longer text is a range of its own."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
