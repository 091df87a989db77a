"""WARC archives: writing pages as records, one gzip member each, and reading them back sequentially.

Archives lie in the shared folder; they are opened through pyarrow's file systems (local mounts, HDFS, S3), as Spark has
no sink for raw bytes. A file is named for its task attempt and only files of successful attempts are listed, so a lost
executor leaves at most an unlisted file. The reader holds one block of a file and one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import joined, mapped, saved, scratch_path

BLOCK = 1 << 18
LEVEL = 4
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


class WarcError(ValueError):
    """An archive that breaks the framing, or whose digest does not match."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def page_name(page_id: int | None) -> str:
    return f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a gzip member with WARC headers, HTTP headers and, unless it is a revisit, the payload."""
    payload_digest = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_name(page_id))}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url or page_name(page_id))}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    if revisit:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_id(page_name(refers_to))}"]
        head += [] if refers_to is None else [f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def members(f: BinaryIO, block: int = BLOCK) -> Iterator[bytes]:
    """The inflated gzip members of a file, one after another, read in blocks."""
    data = f.read(block)
    while data:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data and not (data := f.read(block)):
                raise WarcError("the last gzip member is cut short")
            try:
                parts.append(inflate.decompress(data))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            data = inflate.unused_data
        yield b"".join(parts)
        data = data or f.read(block)


@dataclass
class Record:
    headers: dict[str, str]  # names in lower case
    http: dict[str, str]
    payload: bytes


def _headers(text: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = text.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(member: bytes) -> Record:
    """Frame a record by its Content-Length and verify its digests."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    version, headers = _headers(head)
    if not gap or not version.startswith("WARC/"):
        raise WarcError("no WARC header")
    try:
        n = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    if n < 0 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the block is not of the {n} bytes that its header gives")
    block = rest[:n]
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise WarcError("the block does not match its digest")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    _, http = _headers(http_head)
    if headers.get("warc-type") == "response":
        if int(http.get("content-length", len(payload))) != len(payload):
            raise WarcError("the payload is not of the length that its HTTP header gives")
        if headers.get("warc-payload-digest", f"sha1:{digest(payload)}") != f"sha1:{digest(payload)}":
            raise WarcError("the payload does not match its digest")
    return Record(headers, http, payload)


def _opened(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    return where, inner


#: Most repeated payloads whose digests are broadcast; beyond that the pages of all but the commonest are joined by shuffle.
BROADCAST_ROWS = 500_000


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with what becomes of each: page_id, url, payload, and refers_to where it repeats another's payload.

    Payloads are told apart by their SHA-1. What is decided is decided on ids and digests, pre-aggregated before they are
    shuffled; only digests that occur more than once come back to the pages. They are broadcast if they were counted to be
    few enough, and then no payload is shuffled at all; else ``joined`` leaves the pages of very common ones where they are.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    last = rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("held")).where("held > 1")
    last = saved(last, "repeated")
    if last.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(last.drop("held")), "sha", "left")
    else:
        rows = joined(rows, last, "sha", pages.count(), "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select("page_id", "url", "payload", F.when(revisit, F.col("last")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    where, inner = _opened(path)
                    where.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(inner)
                out.write(record(page_id, url, payload, refers_to, revisit))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return run


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages``, an archive for each task; (path, n_records) of each archive."""
    return saved(mapped(decided(pages, least_bytes), _write(folder), "path string, n_records long", 256), "archives")


RECORDS = "record_id string, type string, uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            where, inner = _opened(path)
            rows, size = [], 0
            with where.open_input_stream(inner) as f:
                for member in members(f):
                    r = parse(member)
                    h, revisit = r.headers, r.headers.get("warc-type") == "revisit"
                    rows.append({
                        "record_id": h.get("warc-record-id"), "type": h.get("warc-type"), "uri": h.get("warc-target-uri"), "page_id": number(h.get("x-page-id")),
                        "refers_to": number(h.get("x-refers-to-page-id")), "payload_bytes": number(r.http.get("content-length")) if revisit else len(r.payload),
                        "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "payload": None if revisit else r.payload,
                    })
                    size += len(r.payload)
                    if size > 1 << 24 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read(archives: DataFrame) -> DataFrame:
    """The records of archives given by a ``path`` column, a task reading whole files from first to last.

    A file that is cut short, wrongly framed or fails a digest raises ``WarcError``. A revisit has no payload of its own;
    payload_bytes and payload_digest are those of the full payload all the same.
    """
    return archives.select("path").mapInArrow(_read, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Null html is the empty payload. Of rows that repeat the largest page_id and its payload, each is a response; a row with
    a null page_id revisits the largest page_id of its payload, or is a response if there is none. A null url is replaced
    by a URN; control characters in one are escaped. An empty table gives no archive and an empty result.
    """
    spark = pages.sparkSession
    archives = write(pages, scratch_path(spark, "warc"), least_bytes)
    n = max(1, min(10_000, archives.count()))
    got = read(archives.repartition(n))
    return got.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
