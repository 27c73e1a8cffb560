"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A token sequence is what the merges make of a piece exactly when every two neighbours in it
are: when merging the bytes of both alone gives the two back. So the encodings of all prefixes
of a piece are paths of a nondeterministic machine whose states are a place in the vocabulary's
trie and the tokens before it. ``Transducer`` runs the subset construction of that machine byte
by byte, emits the tokens that all surviving paths share (a path dies within the longest token's
length, so the lookahead is bounded), and remembers each step it has worked out.

Decoding turns ids into bytes and feeds them to an incremental UTF-8 state machine, a bounded
run of tokens at a time, so that a character split over tokens is held back until it is whole.

Defined cases: a null or empty text has no tokens and decodes to the empty text. Bytes that are
no UTF-8, possible only in ids not made by ``encode``, are kept as lone surrogates by
``stream_text`` and as they are by ``stream_bytes``. doc_id may be null or repeated; each row
stands for itself. Other columns are dropped by ``encode`` and ``decode``. An empty table gives an empty result.
A batch holds about ``BATCH_BYTES`` of texts, or one longer text; what is remembered of pieces, steps and pairs of tokens is
bounded (``_MOST_PIECES``, ``_MOST_STEPS``, ``_MOST_FITS``), and a longer piece is followed without being remembered.
"""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Iterator, Sequence
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import bounded_batches

MAX_VOCABULARY_BYTES = 64 << 20
_MOST_STEPS = 20_000
_MOST_FITS = 250_000
_MOST_PIECES = 250_000
_NONE = 1 << 60
_RUN = 4096


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines "base64-token rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merge(ranks: dict[bytes, int], piece: bytes) -> tuple[list[int], int]:
    """The merges applied one by one, lowest rank first: the definition, for short byte strings.

    Also the length of the left part of the last merge (0 without one).
    """
    parts, left = [piece[i : i + 1] for i in range(len(piece))], 0
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
        if rank == _NONE:
            break
        left = len(parts[i])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts], left


class Transducer:
    """Bytes of one piece in, its tokens out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, rank in ranks.items():
            at = 0
            for byte in text:
                to = self.next[at].get(byte)
                if to is None:
                    to = self.next[at][byte] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                at = to
            self.token[at] = rank
        self.edges: dict[int, tuple] = {}
        self.fits: dict[int, bool] = {}
        start = (-1, (((), 0),))
        self.states = [start]
        self.number = {start: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _edges(self, token: int) -> tuple | None:
        """The parts that stood at the left and right edge of ``token`` while merges made it.

        Each as (bytes, rank of the merge that ended it). None if merging doesn't make the token.
        """
        if token in self.edges:
            return self.edges[token]
        text = self.bytes_of[token]
        whole, cut = merge(self.ranks, text)
        found = None
        if whole == [token]:
            left = right = ()
            if cut:
                left = tuple((t, min(e, token)) for t, e in self._edges(self.ranks[text[:cut]])[0])
                right = tuple((t, min(e, token)) for t, e in self._edges(self.ranks[text[cut:]])[1])
            found = (((text, _NONE), *left), ((text, _NONE), *right))
        self.edges[token] = found
        return found

    def _fits(self, before: int, token: int) -> bool:
        """Whether merging leaves ``token`` whole behind ``before`` (-1: at a piece's start).

        It doesn't if some part at the right edge of ``before`` and some part at the left edge
        of ``token`` merge with each other before the merges that end them; of equal merges
        the left one comes first.
        """
        mine = self._edges(token)
        ok = mine is not None
        if ok and before >= 0:
            rank_of = self.ranks.get
            for right, right_end in self._edges(before)[1]:
                for left, left_end in mine[0]:
                    rank = rank_of(right + left, _NONE)
                    if rank < right_end and rank <= left_end:
                        ok = False
                        break
                if not ok:
                    break
        if len(self.fits) > _MOST_FITS:
            self.fits.clear()
        self.fits[(before + 1) << 32 | token] = ok
        return ok

    def _advance(self, last: int, paths, data: bytes) -> list:
        """The paths that survive ``data``; the one that ends a token there comes last.

        ``last`` is the token before all of them.
        """
        following, token_at, known = self.next, self.token, self.fits.get
        for byte in data:
            alive, ended = [], None
            for held, at in paths:
                to = following[at].get(byte)
                if to is not None:
                    if following[to]:
                        alive.append((held, to))
                    if ended is None:
                        token = token_at[to]
                        if token >= 0:
                            before = held[-1] if held else last
                            ok = known((before + 1) << 32 | token)
                            if self._fits(before, token) if ok is None else ok:
                                ended = (*held, token), 0
            alive.append(ended)
            paths = alive
        return paths

    @staticmethod
    def _emit(last: int, alive: list) -> tuple[tuple[int, ...], int, list]:
        """The tokens that all paths share, the last token given out, and what is left."""
        head = alive[0][0]
        if head and all(held and held[0] == head[0] for held, _ in alive):
            out = commonprefix([held for held, _ in alive])
            return out, out[-1], [(held[len(out) :], at) for held, at in alive]
        return (), last, alive

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, paths = self.states[state]
        out, last, alive = self._emit(last, self._advance(last, paths, bytes((byte,))))
        key = last, tuple(alive)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        self.steps[state << 8 | byte] = to, out
        return to, out

    def encode(self, piece: bytes) -> list[int]:
        """Follows known steps; unknown ones are added while there is room, else taken unremembered."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        out: list[int] = []
        state, steps = 0, self.steps
        for i, byte in enumerate(piece):
            known = steps.get(state << 8 | byte)
            if known is None:
                if len(steps) >= _MOST_STEPS:
                    return out + self._rest(state, piece[i:])
                known = self._step(state, byte)
            state, emitted = known
            if emitted:
                out += emitted
        if state:
            out += self.states[state][1][-1][0]
        return out

    def _rest(self, state: int, tail: bytes) -> list[int]:
        last, alive = self.states[state]
        out: list[int] = []
        for at in range(0, len(tail), 16):
            emitted, last, alive = self._emit(last, self._advance(last, alive, tail[at : at + 16]))
            out += emitted
        return [*out, *alive[-1][0]]


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode has it, in ``regex``'s terms."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def compile_ascii(pattern: str) -> re.Pattern | None:
    """The same for texts of ASCII alone, where the standard library's engine is faster.

    None if the pattern has a Unicode class other than letters and numbers.
    """
    plain = re.sub(r"(\[[^\]]*)\\p\{L\}\\p\{N\}", r"\1A-Za-z0-9", pattern).replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in plain or r"\P" in plain else re.compile(plain, re.A)


class _Pieces(dict):
    """Piece to its ids as int32 bytes, bounded: when full, the pieces used since the last time are kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.transducer = Transducer(ranks)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= _MOST_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def stream_bytes(ids: Sequence[int], bytes_of: dict[int, bytes]) -> Iterator[bytes]:
    """The bytes of ``ids``, a run of tokens at a time."""
    for at in range(0, len(ids), _RUN):
        yield b"".join(map(bytes_of.__getitem__, ids[at : at + _RUN]))


def stream_text(ids: Sequence[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """The text of ``ids``, piece by piece; only whole characters are given out."""
    machine = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    for run in stream_bytes(ids, bytes_of):
        yield machine.decode(run)
    yield machine.decode(b"", final=True)


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, broadcast; its size is checked."""
    with open(path, "rb") as file:
        raw = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


_loaded: dict[int, tuple] = {}


def _tools(shipped, pattern: str | None) -> tuple:
    """This Python worker's tables, made once for each broadcast vocabulary."""
    key = (shipped.id if hasattr(shipped, "id") else id(shipped), pattern)
    if key not in _loaded:
        _loaded.clear()
        ranks = parse_ranks(shipped.value)
        _loaded[key] = (_Pieces(ranks), compile_pattern(pattern), compile_ascii(pattern)) if pattern else ({r: t for t, r in ranks.items()},)
    return _loaded[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    shipped = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, splitter, plain = _tools(shipped, pattern)
        for batch in batches:
            ids = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                find = plain.findall if plain and text.isascii() else splitter.findall
                ids.append(b"".join(map(pieces.__getitem__, find(text))))
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text (as UTF-8 bytes) of every row of ``encoded`` (doc_id, ids)."""
    shipped = _vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bytes_of,) = _tools(shipped, None)
        for batch in batches:
            listed = batch.column(1)
            ids, ends = listed.values.to_numpy(), listed.offsets.to_numpy()
            texts = ["".join(stream_text(ids[a:b].tolist(), bytes_of)).encode("utf-8", "surrogateescape") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    both = decode(encode(docs, path, pattern), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
