"""WARC archives: writing, reading, and revisit resolution.

Payloads stay where they are: only record headers (digest, ids, file, offset, address, date) are shuffled by digest to find
each group's original. A second pass over the archives writes deduplicated ones, where copies become revisit records with
fresh headers, which name the original by its new record id, its address and its date as the format's standard has it. Files
are gzip members, one per record, so a record can be read from its offset.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common

#: Bytes of records after which a task begins a further file.
FILE_BYTES = 64_000_000
#: Record ids of deduplicated archives are made from those of the source in this name space.
_SPACE = uuid.UUID("6f1d2c1e-6c1b-5f0e-9a53-0d1f7b6f2a11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_bytes(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def record(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """One gzip member with a record."""
    return gzip.compress(header_bytes([*fields, ("Content-Length", str(len(body)))]) + body + b"\r\n\r\n", 4, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
    return fields, rest[: int(fields["Content-Length"])]


def members(f: io.RawIOBase) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; memory holds one at a time."""
    start = end = 0
    left = b""
    inflate, parts = zlib.decompressobj(31), []
    while chunk := left or f.read(1 << 20):
        parts.append(inflate.decompress(chunk))
        left = inflate.unused_data
        end += len(chunk) - len(left)
        if inflate.eof:
            yield start, b"".join(parts)
            start = end
            inflate, parts = zlib.decompressobj(31), []


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class _Sink:
    """Files of one task. A file gets its name when it is whole. A task that ran again may leave whole files of its first run: the manifest names those that count."""

    def __init__(self, folder: str):
        self.folder, self.f, self.size = folder, None, 0

    def add(self, data: bytes) -> tuple[str, int]:
        if self.f is None:
            self.fs, self.base = _open(self.folder)
            self.fs.create_dir(self.base, recursive=True)
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.f, self.size = self.fs.open_output_stream(f"{self.base}/{self.name}.part", compression=None), 0
        at = self.size
        self.f.write(data)
        self.size += len(data)
        return self.name, at

    def full(self) -> bool:
        return self.size > FILE_BYTES

    def close(self) -> None:
        if self.f is not None:
            self.f.close()
            self.fs.move(f"{self.base}/{self.name}.part", f"{self.base}/{self.name}")
            self.f = None


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Write a response record per row below folder; returns the manifest (page_id, file, offset) of the files that count.

    Null html: an empty payload; null url: urn:page:id. date: of all records, in ISO form; None: the time of writing. The
    page's id is kept percent-encoded in a header of our own, which a null id lacks.
    """
    common.ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = _Sink(folder)
        for b in batches:
            out = []
            for i, url, html in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                own = [] if i is None else [("WARC-Page-ID", quote(i, safe=""))]
                when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", when), ("WARC-Target-URI", " ".join((url or f"urn:page:{quote(i or '')}").split())), *own, ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
                out.append(sink.add(record(fields, _http(payload))))
                if sink.full():
                    sink.close()
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["page_id", "file", "offset"])
        sink.close()

    rows = pages.select(pages[id_col].alias("id"), pages[id_col].cast("string").alias("name"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return common.stored(rows.mapInArrow(run, f"page_id {kind}, file string, offset long"), "manifest")


def _files(manifest: DataFrame) -> DataFrame:
    """A row per file, dealt over as many partitions as there are files."""
    files = manifest.select("file").distinct()
    return files.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, "file")


def _read(folder: str, name: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    fs, base = _open(folder)
    with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
        for at, raw in members(f):
            fields, body = parse_record(raw)
            yield at, fields, body


def read_headers(manifest: DataFrame, folder: str, kind: str) -> DataFrame:
    """(file, offset, page_id, type, digest, payload_bytes, refers_to, record_id, uri, date, refers_record) of every record of the manifest's files; digests and sizes are taken from the payloads, for revisits from the headers."""
    text = lambda x: None if x is None else unquote(x)
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), *((c, pa.string()) for c in ("refers_to", "record_id", "uri", "date", "refers_record"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                out = []
                for at, fields, body in _read(folder, name):
                    payload = body.partition(b"\r\n\r\n")[2]
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].partition(":")[2] if revisit else payload_digest(payload)
                    row = (name, at, text(fields.get("WARC-Page-ID")), fields["WARC-Type"], digest, -1 if revisit else len(payload), text(fields.get("WARC-Refers-To-Page-ID")), fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"], fields.get("WARC-Refers-To"))
                    out.append(dict(zip(schema.names, row, strict=True)))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    read = _files(manifest).mapInArrow(run, "file string, offset long, page_id string, type string, digest string, payload_bytes long, refers_to string, record_id string, uri string, date string, refers_record string")
    return read.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(file, offset, copy, original) of headers. Of records with equal digest and size of at least least_bytes, the one of the smallest page_id (null: none is smaller; the first in file order stands for equal ones) stays a response; the others are copies, with the original's page_id, record_id, uri and date.

    Originals come from a pre-aggregated group-by; the copies of a large group are dealt over several tasks.
    """
    keys = headers.where(F.col("payload_bytes") >= least_bytes)
    names = ["page_id", "file", "offset", "record_id", "uri", "date"]
    first = keys.groupBy("digest", "payload_bytes").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), *names)).alias("first"), F.count("*").alias("size")).where("size > 1")
    joined = common.join_groups(headers.select(*names, "digest", "payload_bytes"), first, ["digest", "payload_bytes"], headers.count(), "file, offset", "left")
    copy = F.col("first").isNotNull() & ~((F.col("file") == F.col("first.file")) & (F.col("offset") == F.col("first.offset")))
    return joined.select("file", "offset", copy.alias("copy"), F.when(copy, F.col("first")).alias("original"))


def write_deduplicated(resolved: DataFrame, source: str, target: str) -> DataFrame:
    """Copy the archives below source to target, with revisit records for copies; returns the new manifest (file, offset). One task takes one file and the decisions for it, in offset order."""
    decisions = resolved.select("file", "offset", "copy", F.col("original.page_id").cast("string").alias("page"), "original.record_id", "original.uri", "original.date")
    n = resolved.sparkSession.sparkContext.defaultParallelism * 2
    decisions = decisions.repartition(n, "file").sortWithinPartitions("file", "offset")
    fresh_id = lambda old: f"<urn:uuid:{uuid.uuid5(_SPACE, old)}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, name, records = _Sink(target), None, None
        for b in batches:
            out = []
            for file, offset, copy, page, record_id, uri, date in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    name, records = file, _read(source, file)
                at, fields, body = next(records)
                if at != offset:
                    raise ValueError(f"{file}: a record at {at}, a decision for {offset}")
                fresh = [("WARC-Type", "revisit" if copy else "response"), ("WARC-Record-ID", fresh_id(fields["WARC-Record-ID"]))]
                fresh += [(k, v) for k, v in fields.items() if k not in ("WARC-Record-ID", "WARC-Type", "Content-Length")]
                if copy:
                    body = body.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
                    fresh += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", fresh_id(record_id)), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
                    fresh += [] if page is None else [("WARC-Refers-To-Page-ID", quote(page, safe=""))]
                out.append(sink.add(record(fresh, body)))
                if sink.full():
                    sink.close()
            yield pa.record_batch([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["file", "offset"])
        sink.close()

    return common.stored(decisions.mapInArrow(run, "file string, offset long"), "manifest")


def deduplicate_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as WARC, resolve revisits, write deduplicated archives below folder and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, and file and offset of its record.
    Null html is an empty payload. Of equal payloads of least_bytes or more, the smallest page_id is the response; a null
    page_id is behind all others; rows that repeat page_id and payload are told apart by their place in the archive.
    Ids are read back as they were, null ones as null. Other columns aren't read. An empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    raw = common.work_path(spark, "warc-raw")
    target = folder or common.work_path(spark, "warc")
    manifest = write_archive(pages, raw, id_col, url_col, html_col)
    headers = common.stored(read_headers(manifest, raw, kind), "headers")
    final = write_deduplicated(resolve_revisits(headers, least_bytes), raw, target)
    common.remove(spark, raw)
    read = common.stored(read_headers(final, target, kind), "headers")
    # a revisit's size is that of the record it refers to, found by the standard's fields
    copies = read.where("type = 'revisit'").groupBy(F.col("refers_record").alias("record_id")).agg(F.count("*").alias("size"))
    sizes = read.where("type = 'response'").select("record_id", "payload_bytes").join(copies, "record_id").select(F.col("record_id").alias("refers_record"), F.col("payload_bytes").alias("full"), "size")
    joined = common.join_groups(read, sizes, ["refers_record"], read.count(), "record_id", "left")
    return joined.select("page_id", F.when(F.col("type") == "response", F.col("payload_bytes")).otherwise(F.col("full")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "file", "offset")
