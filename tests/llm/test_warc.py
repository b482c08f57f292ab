"""WARC archives: exact round trips, and the parser on other archives."""

import gzip
import hashlib

import pytest

from trackweave.llm.warc import read_chunks, read_records, read_stream, write_archives

SCHEMA = "page_id long, url string, html string"
SHOWN = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute(rows):
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page), page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        origin = first.get(html) if len(payload) >= 100 else None
        again = origin is not None and page != origin
        kind = "revisit" if again else "response"
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), kind, origin if again else None))
    return out


def order(row):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


def compare(spark, frame, folder, **options):
    write_archives(frame, folder, **options)
    read = read_records(spark, folder)
    rows = [tuple(r) for r in frame.select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in read.select(*SHOWN).collect()]
    assert sorted(got, key=order) == sorted(brute(rows), key=order)
    assert read.filter("NOT intact").count() == 0


BIG = "x" * 350 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é" * 5000 + "\n\n\n"
ODD = [
    (5, "http://a/ é\n", BIG),
    (3, None, BIG),
    (None, "u", BIG),
    (3, "u", BIG),
    (9, "q", ""),
    (10, "q", None),
    (11, "q", "ab"),
    (12, "q", "ab"),
    (13, "\r\n", "\n" * 1000),
    (14, "z", "\r\n" * 500 + "\r"),
    (15, "z", "\r" * 99),
    (16, "z", "\r" * 99),
    (None, "n", "y" * 200),
    (None, "n", "y" * 200),
]


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 20])
def test_odd_payloads_come_back(spark, tmp_path, chunk):
    frame = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    folder = str(tmp_path / "archives")
    compare(spark, frame, folder, chunk=chunk)
    chunks = read_chunks(spark, folder, chunk=64).filter("record_type = 'response'").collect()
    texts = {}
    for row in chunks:
        texts.setdefault(row.record_id, {})[row.chunk_no] = bytes(row.data)
    joined = {b"".join(parts[i] for i in sorted(parts)) for parts in texts.values()}
    assert joined == {(html or "").encode() for _, _, html in ODD}
    for row in chunks:
        if row.last:
            parts = texts[row.record_id]
            whole = b"".join(parts[i] for i in sorted(parts))
            assert row.bytes_so_far == len(whole)
            assert row.digest_so_far == hashlib.sha256(whole).hexdigest()
    assert max(len(row.data) for row in chunks) <= 64


def test_pages_of_the_tables(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    compare(spark, pages, str(tmp_path / "archives"), chunk=500)


def test_many_copies_of_one_page(spark, tmp_path):
    rows = [(i, f"u{i}", "same " * 50 if i % 3 else f"page {i}") for i in range(300)]
    compare(spark, spark.createDataFrame(rows, SCHEMA).repartition(16), str(tmp_path / "archives"))


def test_other_columns_do_not_matter(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "x" * 200, "d", 4)], SCHEMA + ", digest string, first_id long")
    compare(spark, frame, str(tmp_path / "archives"))


def test_empty_table(spark, tmp_path):
    compare(spark, spark.createDataFrame([], SCHEMA), str(tmp_path / "archives"))


def record(kind, name, block, *fields):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Members of a record each, other kinds, folded fields, raw bytes."""
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    body = bytes(range(256)) * 40
    records = [
        record("warcinfo", "urn:i", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("response", "urn:r", http + body, "Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://a/\r\n b"),
        record("resource", "urn:s", body, "Content-Type: image/png"),
    ]
    path = tmp_path / "crawl.warc.gz"
    path.write_bytes(b"".join(gzip.compress(r) for r in records))
    rows = {r.record_id: r for r in read_chunks(spark, str(path)).collect()}
    assert bytes(rows["urn:r"].data) == bytes(rows["urn:s"].data) == body
    assert rows["urn:r"].fields["warc-target-uri"] == "http://a/ b"
    assert rows["urn:i"].record_type == "warcinfo"


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_blocks_may_end_anywhere(size):
    stream = record("response", "urn:r", b"HTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n", "Content-Type: application/http") * 2
    blocks = [stream[i : i + size] for i in range(0, len(stream), size)]
    assert [b"".join(parts) for _, _, parts in read_stream(blocks)] == [b"abc\r\n\r\n"] * 2


@pytest.mark.parametrize(
    "broken",
    [
        record("resource", "urn:s", b"abcdef")[:-8],
        b"HTTP/1.1 200 OK\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <u>\r\n\r\nabc\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: resource",
        record("response", "urn:r", b"a", "WARC-Segment-Number: 1"),
        record("continuation", "urn:c", b"a", "WARC-Segment-Origin-ID: <urn:r>", "WARC-Segment-Number: 2"),
    ],
)
def test_broken_archives_are_errors(broken):
    with pytest.raises(ValueError):
        list(read_stream([broken]))
