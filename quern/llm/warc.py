"""WARC archives: a writer, and a reader that splits compressed archives by byte ranges.

Writing: each task writes one file of gzip members, a record each, under a name that holds the
attempt's own random part, and returns that name; a table of the names of the tasks that
succeeded is the archive. What a lost or repeated task left behind is in no such table, so it
is never read.

Reading: files are cut into byte ranges, and a task owns the records that start inside its
range. It scans for the gzip magic and takes a candidate only if it inflates to a WARC version
line and header fields; from the first true record on, each member's end is the next one's
start, so compressed bytes that look like the magic are never taken for a record. The last
record may run over the range's end. Memory is bounded by one record.

Defined cases: a null payload is written like an empty one. Records with equal payloads of at
least ``least`` bytes: that with the smallest page_id is the response, the others revisit it;
rows that share this smallest page_id are all responses; a null page_id revisits one that isn't
null. An empty table makes an empty archive. Urls may be null. Other columns are ignored. A task holds one
batch of about ``BATCH_BYTES`` of pages, or one longer page.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.words import utf8
from quern.runtime import bounded_batches, materialize, shared_path

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 32 << 20
MAX_TASKS = 50_000
#: Type given to a record whose header gives a length that is no number.
MALFORMED = "malformed"
_CHUNK = 1 << 18
#: Compressed bytes that a candidate is probed with at a time.
_PROBE = 512
#: Longest name or comment of a gzip header that is followed, and the longest header with those.
_MOST_NAME = 4096
_MOST_HEADER = 12 + 65535 + 2 * _MOST_NAME + 2
_VERSION = b"WARC/1."
RECORDS = "path string, offset long, page_id string, record_type string, uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


#: Schemes of Hadoop's connectors, by those under which Arrow has a file system of the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "hdfs"}


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI that Spark names, and the path in it.

    Paths without a scheme, ``file:``, ``s3a:`` (as ``s3:``), ``gs:``, ``abfss:`` and ``hdfs:`` are known, as
    far as the tasks' Arrow was built with them; ``hdfs:`` needs Hadoop's native library there. Access keys
    are taken from the environment of the tasks.
    """
    scheme, mark, rest = uri.partition("://")
    if not mark:
        return pafs.FileSystem.from_uri("file://" + os.path.abspath(uri.removeprefix("file:")))
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*head, ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def _clean(value: str | None) -> str:
    """A header value on one line, percent-encoded where a control character stands."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    name = "" if page_id is None else str(page_id)
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Target-URI", _clean(uri)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _member(head, payload if refers_to is None else b"")


def assign(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload and the response each row refers to.

    Payloads are compared by SHA-256. Minima are taken before the shuffle, and only those of groups of
    several rows are joined back, from a table: adaptive execution can then split the
    copies of one payload over tasks.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn(
        "same", F.when(F.length("payload") >= least, F.sha2("payload", 256))
    )
    first = (
        rows.where(F.col("same").isNotNull())
        .groupBy("same")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    first = materialize(first.select("same", "first"), "warc-first")
    refers: Column = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "same", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write(assigned: DataFrame, folder: str) -> DataFrame:
    """Write ``assigned`` (page_id, url, payload, refers_to); path and bytes of the archive's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open_fs(folder)
        path, out, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{path.rpartition('/')[2]}", compression=None)
                size += out.write(record(page, url, payload, refers))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size]})

    files = assigned.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, bytes long")
    return materialize(files, "warc-files")


class _Bytes:
    """A file's bytes from an offset on, read piece by piece. ``at`` is the place in what is held."""

    def __init__(self, file, start: int):
        self.file, self.start, self.held, self.at = file, start, b"", 0
        file.seek(start)

    @property
    def offset(self) -> int:
        return self.start + self.at

    def more(self) -> bool:
        """Reads on, and lets go of what lies before the place."""
        got = self.file.read(max(_CHUNK, len(self.held) - self.at))
        self.held = self.held[self.at :] + got
        self.start, self.at = self.start + self.at, 0
        return bool(got)


def _is_header(data: _Bytes) -> bool:
    """Whether a gzip header stands at the place, with names of at most ``_MOST_NAME`` bytes."""
    while len(data.held) - data.at < _MOST_HEADER and data.more():
        pass
    if data.held[data.at + 3 : data.at + 4] == b"\0":
        return True
    head = data.held[data.at : data.at + _MOST_HEADER]
    if len(head) < 10 or head[3] & 0xE0:
        return False
    to = 10 + (2 + int.from_bytes(head[10:12], "little") if head[3] & 4 else 0)
    for _ in range((head[3] & 8 > 0) + (head[3] & 16 > 0)):
        to = head.find(b"\0", to, to + _MOST_NAME) + 1
        if not to:
            return False
    return to < len(head)


def _inflate(data: _Bytes) -> tuple[bytes, int] | None:
    """The member at the place and its compressed length; None if there is no record there.

    Nothing beyond the version line is inflated before it is known to be one.
    """
    if not _is_header(data):
        return None
    machine, out, used = zlib.decompressobj(31), [], 0
    try:
        begun = b""
        while len(begun) < len(_VERSION):
            if data.at + used == len(data.held) and not data.more():
                return None
            piece = machine.unconsumed_tail + data.held[data.at + used : data.at + used + _PROBE]
            used += len(piece) - len(machine.unconsumed_tail)
            begun += machine.decompress(piece, len(_VERSION) - len(begun))
            if machine.eof:
                break
        if begun != _VERSION:
            return None
        out.append(begun)
        tail = machine.unconsumed_tail
        while not machine.eof:
            if not tail:
                if data.at + used == len(data.held) and not data.more():
                    return None
                tail = data.held[data.at + used :]
                used += len(tail)
            out.append(machine.decompress(tail))
            tail = machine.unconsumed_tail
    except zlib.error:
        return None
    raw = b"".join(out)
    return (raw, used - len(machine.unused_data)) if b"\r\n\r\n" in raw else None


def _number(value: str | None) -> int | None:
    """A length as headers give it: digits alone; 0 without one, None for anything else."""
    value = value or "0"
    return int(value) if value.isascii() and value.isdigit() and len(value) < 19 else None


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record; a record of which a length is no number is of type ``malformed``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    lengths = [_number(fields.get(name)) for name in ("content-length", "x-payload-length")]
    if None in lengths:
        return fields | {"warc-type": MALFORMED}, b""
    return fields, rest[: lengths[0]]


def scan(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, fields and block of the records that start in ``start`` .. ``end``."""
    fs, inner = _open_fs(path)
    with fs.open_input_file(inner) as file:
        data = _Bytes(file, start)
        while data.offset < end:
            found = data.held.find(MAGIC, data.at)
            if found < 0:
                data.at = max(data.at, len(data.held) - len(MAGIC) + 1)
                if not data.more():
                    return
                continue
            data.at = found
            if data.offset >= end:
                return
            member = _inflate(data)
            if member is None:
                data.at += 1
                continue
            yield data.offset, *parse(member[0])
            data.at += member[1]


def _urn(value: str) -> str | None:
    return value.removeprefix("<urn:page:").removesuffix(">") or None


def read(files: DataFrame, range_bytes: int = RANGE_BYTES, malformed: bool = False) -> DataFrame:
    """The records of ``files`` (path, bytes), with columns ``RECORDS``.

    Records whose header gives a length that is no number are left out; with ``malformed`` they are there, with that type, the id
    and address they name, and no payload, to be counted or looked up by path and offset.

    A revisit's payload is null; its digest and length are those that its header gives. For a
    response they are computed from the payload read.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "bytes", starts.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    schema = pa.schema(
        [("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string())]
        + [("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for offset, fields, block in scan(path, start, end):
                    kind = fields.get("warc-type", "")
                    if kind == MALFORMED and not malformed:
                        continue
                    whole = kind not in ("revisit", MALFORMED)
                    named = fields.get("warc-payload-digest", "").partition(":")[2]
                    length = len(block) if whole else _number(fields.get("x-payload-length"))
                    rows.append(
                        (path, offset, _urn(fields.get("warc-record-id", "")), kind, fields.get("warc-target-uri"))
                        + (digest(block) if whole else named, length, _urn(fields.get("warc-refers-to", "")), block if whole else None)
                    )
                    size += len(block)
                    if len(rows) == 256 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    # A task for each range, as far as a scheduler bears; rows so small would else be put in one.
    n = files.agg(F.sum(F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / range_bytes))).first()[0] or 1
    return ranges.repartition(int(min(n, MAX_TASKS)), "path", "start").mapInArrow(run, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to a fresh folder of the shared one, and list its files."""
    bounded_batches(spark)
    return write(assign(pages, least), shared_path(spark, "warc"))
