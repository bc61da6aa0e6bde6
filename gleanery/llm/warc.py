"""WARC archives as a Python data source, format "warc".

Reading plans a partition for each archive, parses a record's header first, holds it against the pushed-down record-type
and header predicates, and passes over the payloads of records that fail them or whose payload isn't asked for, without
decoding them. Writing gives each task an archive of its own under a temporary name, one gzip member to a record; the
commit moves the archives of the tasks that succeeded into place, so what a lost or repeated task left is never read.

Paths go through pyarrow's file systems (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import contextlib
import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from gleanery.llm.common import table, written
from gleanery.sources.scratch import new_path

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, declared_length long, headers map<string,string>, payload binary"
#: Columns that a record's header decides, with the header's name.
_BY_HEADER = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
_STEP = 1 << 16
_BATCH_BYTES = 8 << 20


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Lines:
    """Reads lines and lengths from a stream of bytes and counts what it passes over.

    size is that of a stream that can be moved in: it jumps over bytes, where others must read them.
    """

    def __init__(self, stream, size: int | None = None):
        self.stream = stream if isinstance(stream, (gzip.GzipFile, io.BytesIO)) else io.BufferedReader(stream, _STEP)
        self.size = size
        self.passed = 0

    def line(self, most: int = -1) -> bytes:
        return self.stream.readline(most)

    def take(self, n: int) -> bytes:
        out = self.stream.read(n)
        if len(out) != n:
            raise EOFError("the archive ends inside a record")
        return out

    def pass_over(self, n: int) -> None:
        self.passed += n
        if self.size is not None:
            if self.stream.tell() + n > self.size:
                raise EOFError("the archive ends inside a record")
            self.stream.seek(n, io.SEEK_CUR)
            return
        while n > 0:
            got = len(self.stream.read(min(n, _STEP)))
            if not got:
                raise EOFError("the archive ends inside a record")
            n -= got


def _number(text: str | bytes | None) -> int | None:
    """A length as it should be: digits alone, within a long; else None."""
    text = text.decode("latin-1") if isinstance(text, bytes) else text or ""
    text = text.strip()
    return int(text) if text.isascii() and text.isdigit() and len(text) < 19 else None


def _fields(lines: _Lines) -> dict[str, str]:
    """Header fields up to the blank line; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    while (line := lines.line()) not in (b"", b"\r\n", b"\n"):
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if text[:1] in " \t" and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip()
            out[name] = value.strip()
    return out


def _get(fields: dict[str, str], name: str) -> str | None:
    return fields.get(name) if name in fields else next((v for k, v in fields.items() if k.lower() == name.lower()), None)


def _http_head(lines: _Lines, left: int) -> tuple[int, int | None]:
    """Reads an HTTP header of at most `left` bytes: its size with the blank line, and the Content-Length that it tells."""
    used, told = 0, None
    while used < left:
        line = lines.line(left - used)
        if not line:
            raise EOFError("the archive ends inside a record")
        used += len(line)
        if line in (b"\r\n", b"\n"):
            break
        name, colon, value = line.partition(b":")
        if colon and told is None and name.strip().lower() == b"content-length":
            told = _number(value)
    return used, told


def records(stream, wanted=lambda row: True, payload: bool = True, lines: _Lines | None = None) -> Iterator[dict]:
    """Records of an archive. wanted judges the columns that the header decides, before anything of the block is read.

    Of an HTTP record the header is read line by line; the rest of the block, whatever length that header tells, is the
    payload: read if asked for, else passed over. A transfer encoding isn't undone. payload_length is the payload's own
    size, declared_length what the HTTP header tells (null where that is absent or no number). A record whose own
    Content-Length is absent or no number has no known end: ValueError, as for text that isn't a record; an archive that
    ends inside a record: EOFError.
    """
    lines = lines or _Lines(stream)
    while line := lines.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = _fields(lines)
        left = _number(_get(headers, "Content-Length"))
        if left is None:
            raise ValueError(f"a record without a length: {headers}"[:300])
        row = {c: _get(headers, h) for c, h in _BY_HEADER.items()} | {"headers": headers, "payload": None, "payload_length": None, "declared_length": None}
        if not wanted(row):
            lines.pass_over(left)
            continue
        if (_get(headers, "Content-Type") or "").lower().startswith("application/http"):
            used, row["declared_length"] = _http_head(lines, left)
            left -= used
        row["payload_length"] = left
        if payload:
            row["payload"] = lines.take(left)
        else:
            lines.pass_over(left)
        yield row


@dataclass
class _Archive(InputPartition):
    path: str = ""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


#: What a pushed-down filter asks of a header column's value.
_TESTS = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x),
    StringContains: lambda v, x: x in v,
    IsNotNull: lambda v, x: True,
}


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.schema, self.pushed = schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _BY_HEADER:
                self.pushed.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[_Archive]:
        fs, at = _file_system(self.path)
        if fs.get_file_info(at).type == pafs.FileType.File:
            return [_Archive(self.path)]
        found = [i.path for i in fs.get_file_info(pafs.FileSelector(at, recursive=False, allow_not_found=True)) if i.is_file and i.base_name.endswith((".warc", ".warc.gz"))]
        return [_Archive(f"{self.path.rstrip('/')}/{p.rpartition('/')[2]}") for p in sorted(found)]

    def _wanted(self, row: dict) -> bool:
        return all(row[c] is not None and _TESTS[kind](row[c], x) for kind, c, x in self.pushed)

    def read(self, partition: _Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there is no archive
            return
        fs, at = _file_system(partition.path)
        arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in self.schema])
        packed = at.endswith(".gz")
        with fs.open_input_stream(at, compression=None) if packed else fs.open_input_file(at) as raw:
            lines = _Lines(gzip.GzipFile(fileobj=raw)) if packed else _Lines(raw, raw.size())
            rows, held = [], 0
            for row in records(None, self._wanted, self.payload, lines):
                rows.append({k: list(row[k].items()) if k == "headers" else row[k] for k in arrow.names})
                held += len(row["payload"] or b"") + 500
                if held >= _BATCH_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}


@dataclass
class _Written(WriterCommitMessage):
    name: str | None = None
    n: int = field(default=0)


def _line(value: str) -> str:
    """A header value on one line: control characters are written as in a URL."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(row: dict, date: str) -> bytes:
    """One record: an HTTP response with the payload, or a revisit with the response's header alone."""
    body = row.get("payload") or b""
    size = len(body) if row.get("payload_length") is None else row["payload_length"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + body
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Target-URI", row.get("target_uri")), ("WARC-Date", date), ("WARC-Payload-Digest", row.get("payload_digest"))]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", row.get("refers_to"))]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in headers if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.date, self.level, self.overwrite = options["path"].rstrip("/"), options.get("date", "2024-01-01T00:00:00Z"), int(options.get("level", 1)), overwrite
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, at = _file_system(self.path)
        name, n = f"{uuid.uuid4().hex}.warc.gz", 0
        fs.create_dir(f"{at}/{self.job}", recursive=True)
        with fs.open_output_stream(f"{at}/{self.job}/{name}", compression=None) as out:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                    out.write(gzip.compress(record_bytes(row, self.date), self.level, mtime=0))
                    n += 1
        return _Written(name, n)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, at = _file_system(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(at)):
                if i.is_file:
                    fs.delete_file(i.path)
        for m in messages:
            if m is not None and m.n:
                fs.move(f"{at}/{self.job}/{m.name}", f"{at}/{m.name}")
        self._clean()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, at = _file_system(self.path)
        with contextlib.suppress(FileNotFoundError):
            fs.delete_dir(f"{at}/{self.job}")


class WarcDataSource(DataSource):
    """Options: path (an archive or a folder of them); payload "false" leaves payloads undecoded; date and level for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives at path; filters on header columns are decided before payloads are read.

    Plain archives are moved in, so payloads that aren't asked for are not even read; gzip members are inflated and
    dropped. A folder without archives gives no rows. Header fields that a record lacks are null; broken records raise,
    see ``records``. A payload is one value, so it must fit a task's memory.
    """
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def write_warc(rows: DataFrame, path: str) -> None:
    """Writes (record_id, record_type, target_uri, payload_digest, refers_to, payload_length, payload) as archives."""
    register(rows.sparkSession)
    rows.write.format("warc").option("path", path).mode("append").save()


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """A record for each row: responses, and revisits of payloads of least_bytes or more that a smaller id has.

    Digests are compared on narrow rows. The payloads that come more than once are written as a table of their own, so
    Spark knows its size: while that is small the payloads are not shuffled.

    A null payload is an empty one. A null id is larger than any other; if all ids of a payload are null, and for rows
    that repeat the smallest id, each is a response. A null url is left out of the record. Further columns are not read.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_length", F.length("payload").cast("long"))
    long_ = F.col("payload_length") >= least_bytes
    # One row for each payload that comes more than once; summed before the shuffle.
    copies = rows.where(long_).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    copies = written(copies.select("digest", "first"), "copies")
    joined = rows.join(copies, "digest", "left")
    again = F.coalesce(long_ & F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        urn(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through archives and back: responses by their payloads, revisits by their headers alone."""
    path = new_path(spark, "warc")
    write_warc(deduplicated(table(spark, sf_dir, "pages")), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    whole = lambda c: F.when(number(c) != "", number(c).cast("long"))
    full = read_warc(spark, path).where("record_type = 'response'")
    full = full.select(whole(F.col("record_id")).alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.select(whole(F.col("record_id")).alias("page_id"), F.col("declared_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", whole(F.col("refers_to")).alias("refers_to"))
    return full.union(again)


QUERIES = {"op2_warc": op2_warc}
ORACLE = {
    "op2_warc": """
with p as (select page_id, sha256(coalesce(html, '')) as d, strlen(coalesce(html, ''))::bigint as n from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n as payload_bytes, p.d as payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to
from p left join f on f.d = p.d
"""
}
