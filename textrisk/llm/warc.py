"""Web archives: one gzip member per record, written and read by Spark tasks.

Each task writes its rows to archives of its own and returns their paths; only the paths that
Spark commits are read, so what a lost or repeated task leaves behind is never seen. The reader
goes through an archive once, from front to back, and holds one record: members are inflated
piece by piece, framed by their Content-Length, and checked against their digests.

Archives go to any store that ``pyarrow.fs`` reaches by its address.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textrisk.llm.common import as_batch, field_type, small_batches, stored
from textrisk.sources.scratch import shared_folder

SMALLEST_REVISITED = 100  # bytes; shorter payloads are always stored
ARCHIVE_BYTES = 256 << 20  # compressed; then the task goes on in a new file
READ_BYTES = 64 << 10
GZIP_LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = "urn:x-page:"


class BrokenArchive(ValueError):
    """An archive is cut off, badly framed, or does not match its digests."""


# ---- writing ------------------------------------------------------------------------------


def record(
    page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str
) -> bytes:
    """One record; a revisit when ``refers_to`` is given, which leaves out the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_RECORD_ID}{quote(page_id)}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + ':/?#[]@!$&()*+,;=~')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_RECORD_ID}{quote(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = GZIP_LEVEL) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class _ArchiveWriter:
    """Archives of one task; a new one is begun when the open one is large."""

    def __init__(self, folder: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.folder = folder
        self.out = None

    def write(self, data: bytes) -> tuple | None:
        if self.out is None:
            self.name, self.records, self.size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        return self.close() if self.size >= ARCHIVE_BYTES else None

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        return f"{self.folder}/{self.name}", self.records, self.size


def with_originals(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Adds ``payload_bytes``, ``payload_digest`` and ``refers_to`` to the rows.

    Of equal payloads of at least ``SMALLEST_REVISITED`` bytes the smallest id is stored; the
    others refer to it. Only digests that occur on several ids are joined.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    hashed = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn(
        "payload_digest", F.sha2(payload, 256)
    )
    shared = (
        hashed.where(F.col("payload_bytes") >= SMALLEST_REVISITED)
        .groupBy("payload_digest")
        .agg(F.min(id_col).alias("first"), F.max(id_col).alias("last"))
        .where("first <> last")
        .select("payload_digest", "first")
    )
    refers = F.when(F.col("first") < F.col(id_col), F.col("first"))
    return hashed.join(shared, "payload_digest", "left").withColumn("refers_to", refers).drop("first")


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write every row as a record below ``folder``; returns the stored list of archives
    (``path``, ``records``, ``bytes``).

    Null payloads are empty, null urls are left out, and a null id is written as an empty one.
    Rows that repeat an id and its payload are all stored.
    """
    small_batches(pages.sparkSession)
    rows = with_originals(pages.select(id_col, url_col, payload_col), id_col, payload_col).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), url_col, payload_col, "payload_digest",
        F.col("refers_to").cast("string"),
    )
    schema = T._parse_datatype_string("path string, records long, bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, writer = to_arrow_schema(schema), _ArchiveWriter(folder)
        for batch in batches:
            for key, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(key, url, (payload or "").encode(), digest, refers_to, date)
                if done := writer.write(member(data)):
                    yield as_batch([[x] for x in done], arrow)
        if done := writer.close():
            yield as_batch([[x] for x in done], arrow)

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return stored(rows.mapInArrow(run, schema), "archives")


# ---- reading ------------------------------------------------------------------------------


class _Source:
    """A stream of compressed bytes; what a member did not use is read again."""

    def __init__(self, stream):
        self._stream, self._left = stream, b""

    def read(self) -> bytes:
        data, self._left = self._left or self._stream.read(READ_BYTES), b""
        return data

    def give_back(self, data: bytes) -> None:
        self._left = data

    def at_end(self) -> bool:
        self._left = self.read()
        return not self._left


def _inflated(source: _Source) -> Iterator[bytes]:
    """The pieces of one gzip member."""
    inflate = zlib.decompressobj(31)
    while not inflate.eof:
        data = source.read()
        if not data:
            raise BrokenArchive("the archive ends inside a member")
        try:
            piece = inflate.decompress(data, READ_BYTES)
        except zlib.error as problem:
            raise BrokenArchive(f"a member cannot be inflated: {problem}") from problem
        source.give_back(inflate.unused_data if inflate.eof else inflate.unconsumed_tail)
        if piece:
            yield piece


def members(stream) -> Iterator[Iterator[bytes]]:
    """Of a stream of gzip members: for each, an iterator of its inflated pieces.

    Each member must be used up before the next is asked for.
    """
    source = _Source(stream)
    while not source.at_end():
        yield _inflated(source)


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode().split("\r\n")[1:] if line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def read_record(pieces: Iterator[bytes]) -> dict:
    """One record from the pieces of its member, with framing and digests checked."""
    data = bytearray()
    for piece in pieces:
        data += piece
        if b"\r\n\r\n" in data:
            break
    head, found, rest = bytes(data).partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise BrokenArchive("a member does not start with a record's header")
    fields = _headers(head)
    length = int(fields["content-length"])
    block, digest, size = [], hashlib.sha256(), 0
    tail = b""

    def take(piece: bytes) -> None:
        nonlocal size, tail
        inside = piece[: length - size]
        block.append(inside)
        digest.update(inside)
        size += len(inside)
        tail += piece[len(inside) :]

    take(rest)
    for piece in pieces:
        take(piece)
    if size != length or tail != b"\r\n\r\n":
        raise BrokenArchive(f"a record of {length} bytes is not framed as it says")
    if fields["warc-block-digest"] != f"sha256:{digest.hexdigest()}":
        raise BrokenArchive("a block does not match its digest")
    http, _, payload = b"".join(block).partition(b"\r\n\r\n")
    stated = int(_headers(http)["content-length"])
    kind = fields["warc-type"]
    payload_digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if len(payload) != stated or hashlib.sha256(payload).hexdigest() != payload_digest:
            raise BrokenArchive("a payload does not match its length or digest")
    return {
        "record_type": kind,
        "id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": stated,
        "payload_digest": payload_digest,
        "refers_to": _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": payload if kind == "response" else None,
    }


def _page(urn: str) -> str | None:
    return unquote(urn.strip("<>").removeprefix(_RECORD_ID)) or None


def read_archives(archives: DataFrame, id_type: T.DataType, with_payload: bool = True) -> DataFrame:
    """One row per record of the listed archives (``path``), ids cast back to ``id_type``.

    Columns: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to`` and, if asked for, ``payload``, null for revisits. A broken archive raises.
    """
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = T._parse_datatype_string(
        "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
        + ", payload binary" * with_payload
    )
    names += ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as source:
                    rows: list[dict] = []
                    for pieces in members(source):
                        rows.append(read_record(pieces))
                        if len(rows) == 256:
                            yield as_batch([[row[name] for row in rows] for name in names], arrow)
                            rows = []
                if rows:
                    yield as_batch([[row[name] for row in rows] for name in names], arrow)

    # One task per archive; a hash of the paths would be merged into few tasks, being small.
    spread = archives.select("path").repartition(max(1, archives.count()))
    found = spread.mapInArrow(run, schema)
    return found.withColumn("refers_to", F.col("refers_to").cast(id_type)).select(
        F.col("id").cast(id_type).alias("page_id"), *names[1:]
    )


def round_trip(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    with_payload: bool = True,
) -> DataFrame:
    """Write the rows below ``spark.checkpoint.dir`` and read them back; one row per input row."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, folder, id_col, url_col, payload_col)
    return read_archives(archives, field_type(pages, id_col), with_payload)
