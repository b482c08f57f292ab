"""WARC archives of pages, written and read as a table of chunks.

A payload travels as rows (record_id, chunk_no) of at most ``CHUNK`` bytes with the
digest of all bytes so far, never as one block built from header and payload. A
payload of several chunks is a segmented record of the format: a response with
``WARC-Segment-Number: 1`` and continuations that name it. Spark's text writer puts
the chunk rows of a task into one compressed file, so a retried task replaces its own
file and nothing else, and archives can lie in any store that Spark writes to. A
compressed file is read by one task from its beginning; its lines are handed on as
blocks, and the parser keeps a header, or the rest of a chunk, never a whole record.

Writing, equal payloads of ``SHARED_BYTES`` or more are stored once: the row with the
smallest page_id is the response, the others are revisits that refer to it. The
groups of equal payloads are counted by digest before the shuffle, and only digests
that occur twice are joined back, by ``lookup_join``: broadcast up to a counted number
of rows of fixed width, else over salts, so a group that holds a third of all pages is
spread over tasks.

Reading, revisits get their length from the response they refer to.

Edge cases: a null html is an empty payload, an empty payload is a response; a null
page_id leaves its header out, is never the smallest, and a group of nulls only is
all responses, as are rows that repeat the smallest page_id; a null url leaves its
header out, control characters, spaces and letters beyond ASCII in one are written as
%XX. Other columns are not read, whatever their names. An empty table makes archives
without records. A payload may hold anything, also whole records: lengths decide,
not contents. A record that is cut off or has no length is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import store
from ..operators.dimensions import lookup_join

CHUNK = 1 << 20
# Payloads of fewer bytes are never revisits.
SHARED_BYTES = 100
# Bytes of chunks that a task hands on at a time.
_BATCH_BYTES = 8 << 20
# The longest head of HTTP that is looked for.
_HEAD_BYTES = 1 << 16

# The words of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
PAGE_FIELD = "X-Page-Id"

_END = b"\r\n"


def record_name(page_id: Column, digest: Column) -> Column:
    """The id of the record of a page, a URN made from the page and its payload."""
    name = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    places = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(name, *p) for p in places]))


def described_pages(pages: DataFrame) -> DataFrame:
    """(record_id, page_id, url, html, digest, refers_to): what to write for each row.

    ``refers_to`` is the id of the record that holds the same payload, or null.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(bytearray()))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    shared = (
        rows.filter(F.length("html") >= SHARED_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1 AND first_id IS NOT NULL")
        .select("digest", "first_id")
    )
    joined = lookup_join(rows, store(shared), ["digest"], "left")
    repeats = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        record_name(F.col("page_id"), F.col("digest")).alias("record_id"),
        "page_id",
        "url",
        "html",
        "digest",
        F.when(repeats, record_name(F.col("first_id"), F.col("digest"))).alias("refers_to"),
    )


def _address(url: str) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _header(kind: str, record_id: str, length: int, fields: Iterable[tuple[str, object]]) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *fields, ("Content-Length", length)]
    lines = [VERSION, *(f"{name}: {value}" for name, value in named if value is not None)]
    return "\r\n".join(lines).encode() + _END + _END


def page_chunks(
    record_id: str, page_id: int | None, url: str | None, payload: memoryview, digest: str,
    refers_to: str | None, date: str, chunk: int = CHUNK,
) -> Iterator[tuple[int, list[bytes | memoryview], str]]:
    """(chunk_no, parts, digest so far) of a page. The parts are views of the payload
    and the bytes around them; joined they are one record of the format."""
    fields = [
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _address(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        (PAGE_FIELD, page_id),
    ]
    if refers_to is not None:
        more = [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{refers_to}>")]
        yield 0, [_header("revisit", record_id, 0, fields + more), _END, _END], digest
        return
    size = len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    fields.append(("Content-Type", HTTP_TYPE))
    so_far = hashlib.sha256()
    for number, begin in enumerate(range(0, max(size, 1), chunk)):
        part = payload[begin : begin + chunk]
        so_far.update(part)
        last = begin + chunk >= size
        if number == 0:
            segment = [] if last else [("WARC-Segment-Number", 1)]
            head = _header("response", record_id, len(http) + len(part), fields + segment) + http
        else:
            segment = [
                ("WARC-Date", date),
                ("WARC-Segment-Origin-ID", f"<{record_id}>"),
                ("WARC-Segment-Number", number + 1),
                ("WARC-Segment-Total-Length", len(http) + size if last else None),
            ]
            head = _header("continuation", f"{record_id}:{number + 1}", len(part), segment)
        yield number, [head, part, _END, _END], so_far.hexdigest()


_CHUNK_TYPE = pa.schema(
    [("record_id", pa.string()), ("chunk_no", pa.int32()), ("digest_so_far", pa.string()), ("record", pa.binary())]
)
CHUNK_ROW = "record_id string, chunk_no int, digest_so_far string, record binary"


def _batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = _BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``limit`` bytes of their last column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 100
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def chunk_table(described: DataFrame, date: str, chunk: int = CHUNK) -> DataFrame:
    """Rows (record_id, chunk_no, digest_so_far, record) of pages, in order within a task."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                plain = [columns[c][i].as_py() for c in ("record_id", "page_id", "url", "digest", "refers_to")]
                payload = memoryview(columns["html"][i].as_buffer())
                name, page_id, url, digest, refers_to = plain
                for number, parts, so_far in page_chunks(name, page_id, url, payload, digest, refers_to, date, chunk):
                    yield name, number, so_far, b"".join(parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), _CHUNK_TYPE)

    ordered = described.select("record_id", "page_id", "url", "html", "digest", "refers_to")
    return ordered.mapInArrow(run, CHUNK_ROW)


def write_archives(pages: DataFrame, path: str, date: str | None = None, chunk: int = CHUNK) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to compressed archives
    in the folder ``path``, a file per task. ``date`` stands in every record, by
    default the time of the call."""
    stamp = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    chunks = chunk_table(described_pages(pages), stamp, chunk)
    # The writer ends every row with a line feed, which is the last byte of a record.
    whole = F.substring("record", F.lit(1), F.length("record") - 1).cast("string")
    chunks.select(whole.alias("value")).write.text(path, compression="gzip", lineSep="\n")


@dataclass
class _Record:
    """What is known of the record, or segmented record, that is being read."""

    record_id: str
    kind: str
    fields: dict[str, str]
    left: int = 0
    http: bool = False
    head: bytes = b""
    size: int = 0
    chunk_no: int = 0
    open: bool = False
    so_far: object = field(default_factory=hashlib.sha256)


def _named(value: str | None) -> str | None:
    return None if value is None else value.strip("<>")


class _Stream:
    """Bytes in front of the parser: blocks are taken as they come, never joined."""

    def __init__(self, blocks: Iterable[bytes]) -> None:
        self.blocks, self.block, self.at = iter(blocks), b"", 0

    def more(self) -> bool:
        while self.at >= len(self.block):
            following = next(self.blocks, None)
            if following is None:
                return False
            self.block, self.at = following, 0
        return True

    def some(self, limit: int) -> memoryview:
        """Up to ``limit`` bytes of the current block; none at the end."""
        if not self.more():
            return memoryview(b"")
        part = memoryview(self.block)[self.at : self.at + limit]
        self.at += len(part)
        return part

    def line(self) -> bytes:
        """A line without its end."""
        parts = []
        while self.more():
            end = self.block.find(b"\n", self.at)
            if end >= 0:
                parts.append(self.block[self.at : end])
                self.at = end + 1
                return b"".join(parts).rstrip(b"\r")
            parts.append(self.block[self.at :])
            self.at = len(self.block)
        raise ValueError("an archive ends inside a header")


def _headers(stream: _Stream) -> dict[str, str]:
    fields, name = {}, None
    while line := stream.line():
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            fields[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise ValueError(f"not a header: {text[:80]}")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def read_stream(blocks: Iterable[bytes], chunk: int = CHUNK) -> Iterator[tuple[_Record, bool, list[memoryview]]]:
    """(record, last, parts) for every chunk of the payloads in a stream of records.

    Continuations go on with the chunks of the record before them. A response of
    HTTP is read without the head of that protocol.
    """
    stream, record = _Stream(blocks), None
    while stream.more():
        version = stream.line()
        if not version:
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a record: {bytes(version[:80])!r}")
        fields = _headers(stream)
        if not fields.get("content-length", "").isdigit() or "warc-record-id" not in fields:
            raise ValueError("a record without its length or its id")
        kind, left = fields.get("warc-type", ""), int(fields["content-length"])
        if kind == "continuation":
            origin = _named(fields.get("warc-segment-origin-id"))
            if record is None or not record.open or record.record_id != origin:
                raise ValueError(f"a continuation away from its record {origin}")
            record.open = "warc-segment-total-length" not in fields
        else:
            if record is not None and record.open:
                raise ValueError(f"no last segment of {record.record_id}")
            record = _Record(_named(fields["warc-record-id"]), kind, fields, open="warc-segment-number" in fields)
            record.http = fields.get("content-type", "").startswith("application/http") and kind == "response"
        record.left = left
        while record.http and record.left:
            # The head ends at an empty line; it may span blocks, but not segments.
            part = stream.some(min(record.left, _HEAD_BYTES))
            if not part:
                raise ValueError(f"an archive ends inside {record.record_id}")
            before = len(record.head)
            record.head += bytes(part)
            end = record.head.find(b"\r\n\r\n")
            if end >= 0:
                used = end + 4 - before
                record.http, record.head = False, record.head[:end]
                record.left -= used
                stream.at -= len(part) - used
            elif len(record.head) > _HEAD_BYTES:
                raise ValueError(f"no end of the head of {record.record_id}")
            else:
                record.left -= len(part)
        held, size = [], 0
        while record.left:
            part = stream.some(min(record.left, chunk - size))
            if not part:
                raise ValueError(f"an archive ends inside {record.record_id}")
            record.left -= len(part)
            record.size += len(part)
            record.so_far.update(part)
            held.append(part)
            size += len(part)
            if size == chunk and record.left:
                yield record, False, held
                record.chunk_no += 1
                held, size = [], 0
        if held or not record.open:
            yield record, not record.open, held
            record.chunk_no += 1
    if record is not None and record.open:
        raise ValueError(f"no last segment of {record.record_id}")


_READ_TYPE = pa.schema(
    [
        ("record_id", pa.string()),
        ("chunk_no", pa.int32()),
        ("last", pa.bool_()),
        ("record_type", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()),
        ("data", pa.binary()),
    ]
)
READ_ROW = (
    "record_id string, chunk_no int, last boolean, record_type string, fields map<string, string>, "
    "bytes_so_far long, digest_so_far string, data binary"
)


def read_chunks(spark: SparkSession, path: str, data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The payloads of compressed archives as rows of (record_id, chunk_no).

    ``last`` marks the end of a record; its row has the length and digest of the whole
    payload, and the record's header ``fields`` by lower-case name. Without ``data``
    only those last rows are made, and no payload leaves the tasks that read.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        blocks = (b"\n".join(batch.column(0).to_pylist()) + b"\n" for batch in batches if batch.num_rows)
        for record, last, parts in read_stream(blocks, chunk):
            if data or last:
                yield (
                    record.record_id,
                    record.chunk_no,
                    last,
                    record.kind,
                    list(record.fields.items()) if last else None,
                    record.size,
                    record.so_far.hexdigest(),
                    b"".join(parts) if data else None,
                )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), _READ_TYPE)

    lines = spark.read.text(path, lineSep="\n").select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, READ_ROW)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_id, record_type, payload_bytes, payload_digest, refers_to,
    intact) of the pages in archives; ``refers_to`` is a page_id.

    The length and digest of a revisit are those of the response it refers to.
    ``intact`` says whether the digest in the header is that of the payload.
    """
    ends = read_chunks(spark, path, data=False).filter("last")
    stated = F.regexp_extract(F.col("fields")["warc-payload-digest"], "^sha256:(.*)$", 1)
    records = store(ends.select(
        F.col("fields")[PAGE_FIELD.lower()].cast("long").alias("page_id"),
        F.col("fields")["warc-target-uri"].alias("url"),
        "record_id",
        "record_type",
        F.col("bytes_so_far").alias("own_bytes"),
        F.col("digest_so_far").alias("own_digest"),
        stated.alias("stated"),
        F.trim(F.col("fields")["warc-refers-to"], F.lit("<>")).alias("origin"),
    ))
    named = records.filter("record_type = 'revisit'").select(F.col("origin").alias("record_id")).distinct()
    origins = (
        records.filter("record_type = 'response'")
        .join(named, "record_id", "left_semi")
        .groupBy(F.col("record_id").alias("origin"))
        .agg(
            F.min("page_id").alias("origin_page"),
            F.min("own_bytes").alias("origin_bytes"),
            F.min("own_digest").alias("origin_digest"),
        )
    )
    joined = lookup_join(records, store(origins), ["origin"], "left")
    revisit = F.col("record_type") == "revisit"
    digest = F.when(revisit, F.col("origin_digest")).otherwise(F.col("own_digest"))
    return joined.select(
        "page_id",
        "url",
        "record_id",
        "record_type",
        F.when(revisit, F.col("origin_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.when(revisit, F.col("origin_page")).alias("refers_to"),
        (digest == F.col("stated")).alias("intact"),
    )
