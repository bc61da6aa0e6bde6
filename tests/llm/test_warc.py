from __future__ import annotations

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from gleanery.llm import warc

PAGES = "page_id long, url string, html string, digest string, first int, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


LONG, OTHER = "é" * 60, "b" * 100
ROWS = [(5, "http://a/\r\nX-Evil: 1", LONG), (2, None, LONG), (9, "http://c", LONG), (3, "http://d", None), (4, "", ""), (6, "http://e", "short"), (7, "http://f", "short"), (8, "http://g", OTHER), (None, "http://h", OTHER), (1, "http://i", "a\r\n\r\nWARC/1.1\r\n" * 20), (8, "http://g", OTHER)]


def brute(rows):
    out, first = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None:
            first[b] = min(first.get(b, i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and b in first and (i is None or i > first[b])
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    pages(spark, ROWS).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op2_warc(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS)


def test_sql(spark, tmp_path, same):
    rows = [r for r in ROWS if r[0] is not None]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    same(warc.op2_warc(spark, str(tmp_path)), warc.ORACLE["op2_warc"], pages=spark.read.parquet(str(tmp_path / "pages.parquet")))


def test_empty(spark, tmp_path):
    pages(spark, []).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op2_warc(spark, str(tmp_path)).collect() == []


def test_payloads_and_headers_come_back(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(warc.deduplicated(pages(spark, ROWS)), path)
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith("_job")]
    back = {(r.record_id, r.record_type): r for r in warc.read_warc(spark, path).collect()}
    assert bytes(back["<urn:page:1>", "response"].payload).decode() == ROWS[9][2]
    r = back["<urn:page:5>", "revisit"]
    assert (r.declared_length, r.payload_length, bytes(r.payload), r.refers_to) == (120, 0, b"", "<urn:page:2>")
    assert "X-Evil" not in r.headers and r.target_uri == "http://a/%0D%0AX-Evil: 1"


def test_pushdown_passes_over_payloads(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(warc.deduplicated(pages(spark, ROWS)), path)
    some = warc.read_warc(spark, path, payload=False).where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://") & F.col("record_id").isin("<urn:page:6>", "<urn:page:5>"))
    assert [(r.record_id, r.payload, r.payload_length) for r in some.collect()] == [("<urn:page:6>", None, 5)]
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan or "record_type = response" not in plan


def test_header_first():
    data = b"".join(warc.record_bytes({"record_type": t, "record_id": f"<{i}>", "payload": b"x" * 5000}, "2024-01-01T00:00:00Z") for i, t in enumerate(("response", "request", "response")))
    lines = warc._Lines(io.BytesIO(data))
    got = list(warc.records(None, lambda r: r["record_type"] == "request", lines=lines))
    assert [(r["record_id"], len(r["payload"])) for r in got] == [("<1>", 5000)]
    assert lines.passed > 10_000


def test_plain_and_gzip_archives(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nwarc-record-id: <i>\r\nX-Long: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(info))
    (tmp_path / "skip.txt").write_bytes(b"no archive")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r.record_id, bytes(r.payload), r.headers["X-Long"]) for r in got] == [("<i>", b"abc", "a b")] * 3


def test_broken_archive():
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(b"WARC/1.0\r\nContent-Length: 10\r\n\r\nabc")))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records(io.BytesIO(b"nonsense\r\n")))
    for told in (b"", b"Content-Length: ten\r\n", b"Content-Length: -1\r\n"):
        with pytest.raises(ValueError, match="without a length"):
            list(warc.records(io.BytesIO(b"WARC/1.0\r\n" + told + b"\r\nabc")))


SIZES = [0, 1, 1000, 65_000, 70_000, 300_000]
TOLD = [None, 0, 50_000, 200_000, "x", "1" * 30]


def http_record(number, size, told, blank=b"\r\n"):
    body = (b"%d:" % number + b"line\r\n\r\nWARC/1.0\r\n" * (size // 10 + 1))[:size]
    head = b"HTTP/1.1 200 OK\r\nX: y\r\n" + (b"" if told is None else f"CONTENT-LENGTH: {told}\r\n".encode()) + blank
    block = head + body
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{number}>\r\nContent-Type: Application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", body


def common_archive():
    made = [(size, told, *http_record(i, size, told)) for i, (size, told) in enumerate((s, t) for s in SIZES for t in TOLD)]
    whole = b"".join(r for _, _, r, _ in made)
    want = [(f"<{i}>", len(body), told if isinstance(told, int) else None, body) for i, (_, told, _, body) in enumerate(made)]
    return made, whole, want


@pytest.mark.parametrize("payload", [True, False])
@pytest.mark.parametrize("kind", ["plain", "moved", "gzip"])
def test_common_archives(kind, payload):
    """Lengths that are absent, wrong or no numbers; bodies below and above a read's size; what isn't wanted is passed over."""
    made, whole, want = common_archive()
    if kind == "gzip":
        lines = warc._Lines(gzip.GzipFile(fileobj=io.BytesIO(b"".join(gzip.compress(r) for _, _, r, _ in made))))
    else:
        lines = warc._Lines(io.BytesIO(whole), len(whole) if kind == "moved" else None)
    got = [(r["record_id"], r["payload_length"], r["declared_length"], r["payload"]) for r in warc.records(None, payload=payload, lines=lines)]
    assert got == [(i, n, told, body if payload else None) for i, n, told, body in want]
    assert lines.passed == (0 if payload else sum(n for _, n, _, _ in want))


def test_common_archives_in_spark(spark, tmp_path):
    made, whole, want = common_archive()
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for _, _, r, _ in made))
    full = sorted((r.record_id, r.payload_length, r.declared_length, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert full == sorted(2 * want, key=lambda w: w[0])
    bare = [(r.record_id, r.payload_length, r.payload) for r in warc.read_warc(spark, str(tmp_path), payload=False).where("record_id = '<35>'").collect()]
    assert bare == 2 * [("<35>", 300_000, None)]


def test_a_header_without_an_end():
    block = b"HTTP/1.1 200 OK\r\nX: y"
    data = b"WARC/1.0\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    assert [(r["payload_length"], r["payload"]) for r in warc.records(io.BytesIO(2 * data))] == 2 * [(0, b"")]
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(data[:-10])))
