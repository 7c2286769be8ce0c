"""WARC: records as a table of chunks.

Payloads are streamed: a record gives rows (record id, chunk number) of at most ``chunk_bytes`` bytes, each with the SHA-1
of the payload up to and including it, so that a reader can check as it goes and no record is ever held whole. The reader
takes .warc and .warc.gz files (of one or many gzip members), one task for each file; the writer makes one gzip member
for each record, from a table of payloads, and names each file by its content's partition, so that a task run twice
writes the same file. Files are opened through pyarrow's file systems (local, HDFS, S3, GCS by URI).

Defined results: an empty payload is one chunk of 0 bytes. Null payloads and rows with a null id are not written.
Rows that repeat an id are separate records of equal id, told apart by ``file`` and ``record_no``. A null URL is left out of the header. A record cut off
by the end of its file gives the chunks that are there, the last with ``complete`` false, as does one whose gzip
stream is damaged; bytes that don't begin a WARC record end the reading of their file with one row of chunk number -1. Records of every type
come out. Extra columns of the table don't matter. An empty table or folder gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textquarry.llm._util import shared_dir, table

CHUNK_BYTES = 16_384
_FIELDS = [("file", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("chunk_no", pa.int32()), ("offset", pa.int64()), ("n_bytes", pa.int32()), ("payload", pa.binary()), ("sha1", pa.string()), ("is_last", pa.bool_()), ("complete", pa.bool_()), ("digest_ok", pa.bool_())]
SCHEMA = "file string, record_no long, record_id string, warc_type string, target_uri string, chunk_no int, offset long, n_bytes int, payload binary, sha1 string, is_last boolean, complete boolean, digest_ok boolean"


def _open(uri: str, mode: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if mode == "rb":
        return where.open_input_stream(path, compression=None)
    return where.open_output_stream(path, compression=None)


class _Bytes(io.RawIOBase):
    """A pyarrow stream as raw Python input."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.stream.read(len(b))
        b[: len(data)] = data
        return len(data)


def _read(f: BinaryIO, n: int) -> bytes:
    """Up to n bytes; fewer at the end of the file or of what can be decompressed."""
    try:
        return f.read(n)
    except (EOFError, OSError, zlib.error):
        return b""


def _line(f: BinaryIO, most: int = 65_536) -> bytes:
    """A line, at most so many bytes of it; -1 for the whole line."""
    try:
        return f.readline(most)
    except (EOFError, OSError, zlib.error):
        return b""


def read_chunks(f: BinaryIO, name: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of SCHEMA from an open, decompressed WARC stream."""
    number = -1
    while True:
        line = _line(f)
        while line in (b"\r\n", b"\n"):
            line = _line(f)
        if not line:
            return
        number += 1
        headers: dict[str, str] = {}
        if line.startswith(b"WARC/"):
            while (line := _line(f, -1)) not in (b"\r\n", b"\n", b""):
                key, colon, value = line.decode("utf-8", "replace").partition(":")
                if colon:
                    headers.setdefault(key.strip().lower(), value.strip())
        size = headers.get("content-length", "")
        if not size.isdigit():
            yield name, number, None, None, None, -1, 0, 0, b"", None, True, False, None
            return
        left, offset, chunk, digest = int(size), 0, 0, hashlib.sha1(usedforsecurity=False)
        about = (name, number, headers.get("warc-record-id", "").strip("<>") or None, headers.get("warc-type"), headers.get("warc-target-uri"))
        told = headers.get("warc-block-digest", headers.get("warc-payload-digest" if headers.get("warc-type") == "resource" else "", ""))
        while True:
            want = min(chunk_bytes, left)
            data = _read(f, want)
            while len(data) < want and (more := _read(f, want - len(data))):
                data += more
            digest.update(data)
            left -= len(data)
            complete = len(data) == want
            last = not left or not complete
            ok = None
            if last and complete and told[:5].lower() == "sha1:":
                ok = told[5:].upper() in (base64.b32encode(digest.digest()).decode(), digest.hexdigest().upper())
            yield *about, chunk, offset, len(data), data, digest.hexdigest(), last, complete, ok
            offset += len(data)
            chunk += 1
            if last:
                break
        if not complete:
            return


def warc_chunks(spark: SparkSession, uris: list[str] | DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of WARC files: a list of URIs, or a table with a column ``uri``."""
    files = uris if isinstance(uris, DataFrame) else spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, len(uris)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with _open(uri, "rb") as stream:
                    raw = io.BufferedReader(_Bytes(stream), 1 << 16)
                    f = gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
                    for row in read_chunks(f, uri.rsplit("/", 1)[-1], chunk_bytes):
                        rows.append(row)
                        size += row[7] + 300
                        if size > 4_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.select("uri").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], [n for n, _ in _FIELDS])


def record(record_id: str, uri: str | None, payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The bytes of a resource record, piece by piece."""
    digest = hashlib.sha1(usedforsecurity=False)
    view = memoryview(payload)
    for i in range(0, len(view), chunk_bytes):
        digest.update(view[i : i + chunk_bytes])
    target = f"WARC-Target-URI: {' '.join(uri.split())}\r\n" if uri else ""
    yield f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{record_id}>\r\n{target}WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Block-Digest: sha1:{base64.b32encode(digest.digest()).decode()}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(view)}\r\n\r\n".encode()
    for i in range(0, len(view), chunk_bytes):
        yield view[i : i + chunk_bytes]
    yield b"\r\n\r\n"


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", level: int = 1) -> DataFrame:
    """Writes the table as .warc.gz files into ``folder`` (a URI) when an action runs; (uri, records) of each file.

    A file has its task's partition as name: a task that is run again writes the same bytes to the same place,
    under a name of its own that is then moved there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        part = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        own = f"{base}/_{uuid.uuid4().hex}-{part}"
        n = 0
        with where.open_output_stream(own, compression=None) as out:
            for b in batches:
                for i, url, payload in zip(*(b.column(k) for k in range(3))):
                    packer = zlib.compressobj(level, wbits=31)
                    for piece in record(f"urn:page:{i.as_py()}", url.as_py(), payload.as_buffer()):
                        out.write(packer.compress(piece))
                    out.write(packer.flush())
                    n += 1
        where.move(own, f"{base}/{part}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{part}"]), pa.array([n], pa.int64())], ["uri", "records"])

    payload = F.col(payload_col)
    if dict(df.dtypes)[payload_col] != "binary":
        payload = F.encode(payload.cast("string"), "UTF-8")
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(uri_col).cast("string").alias("u"), payload.alias("p")).where("i is not null and p is not null")
    return rows.mapInArrow(run, "uri string, records long")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files and read back as chunks."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    uris = [r.uri for r in write_warc(table(spark, sf_dir, "pages"), folder).select("uri", "records").collect() if r.records]
    chunks = warc_chunks(spark, uris)
    return chunks.select(F.regexp_extract("record_id", r"urn:page:(-?\d+)", 1).cast("long").alias("page_id"), F.col("target_uri").alias("url"), "chunk_no", "offset", "n_bytes", F.regexp_replace(F.base64("payload"), "[\r\n]+", "").alias("payload"), "sha1", "is_last", "digest_ok")


#: In SQL: slices of the payload in hexadecimal digits, and the digest of each prefix.
_SQL = f"""
WITH p AS (SELECT page_id, url, encode(html) AS b, hex(encode(html)) AS h FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL),
c AS (SELECT *, unnest(range(greatest(1, (octet_length(b) + {CHUNK_BYTES - 1}) // {CHUNK_BYTES}))) AS k FROM p),
d AS (SELECT page_id, url, k, octet_length(b) AS size, least({CHUNK_BYTES}, octet_length(b) - k * {CHUNK_BYTES}) AS n, h FROM c)
SELECT page_id, url, k::INTEGER AS chunk_no, (k * {CHUNK_BYTES})::BIGINT AS "offset", n::INTEGER AS n_bytes,
       base64(unhex(substr(h, 2 * k * {CHUNK_BYTES} + 1, 2 * n))) AS payload, sha1(unhex(substr(h, 1, 2 * (k * {CHUNK_BYTES} + n)))) AS sha1,
       k * {CHUNK_BYTES} + n >= size AS is_last, CASE WHEN k * {CHUNK_BYTES} + n >= size THEN true END AS digest_ok
FROM d"""

QUERIES = {"op1_warc_chunks": op1_warc_chunks}
ORACLES = {"op1_warc_chunks": _SQL}
