"""WARC archives written from a table and read back as chunk rows.

Writing and reading go through Spark's own text writer and reader, a row for each line of the archive, so any store that Spark
reaches will do. Archives are gzip files, which no reader splits: one task meets a file's lines in order. A payload is passed on
as rows of record identifier and chunk number, with the SHA-1 of all of it so far. A payload in which line feeds lie further apart
than ``CHUNK`` bytes is written with the chunked transfer coding of HTTP, so that no line of an archive is longer than that, and
neither side holds more of a record than a batch of lines of about that size; the writer has the payload where its table has it, in
one Arrow buffer, and cuts pieces from it. Archives of others are read alike, but each line of theirs is held as a whole.

Nulls: a null payload is empty, a null url or page_id leaves its header out. Repeated rows give a record each; of equal payloads
those with the largest page_id are responses. Empty table: an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.llm.common import small, written

#: Payloads of fewer bytes are always written in full.
LEAST = 1000
CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}>"


def chunked_size(size: int, chunk: int) -> int:
    """Bytes of a payload in chunked transfer coding."""
    full, rest = divmod(size, chunk)
    return size + full * (len(f"{chunk:x}") + 4) + (len(f"{rest:x}") + 4 if rest else 0) + 5


def far_apart(payload: memoryview, chunk: int) -> bool:
    """Whether over ``chunk`` bytes of the payload go by without a line feed."""
    last = -1
    for at in range(0, len(payload), chunk):
        feeds = at + np.flatnonzero(np.frombuffer(payload[at : at + chunk], np.uint8) == 10)
        if len(feeds):
            if feeds[0] - last > chunk:
                return True
            # Feeds of one piece are closer than the piece is long.
            last = int(feeds[-1])
    return len(payload) - last > chunk


def _head(page_id, url, digest: str, size: int, top, chunk: int = 0) -> tuple[bytes, bytes]:
    """The headers of a record, and those of the response in it; with ``chunk`` its payload is in chunks of so many bytes."""
    revisit = top is not None and top != page_id
    length = "Transfer-Encoding: chunked" if chunk else f"Content-Length: {size}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{length}\r\n\r\n".encode()
    if chunk:
        size = chunked_size(size, chunk)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(top, digest)}", f"X-Refers-To-Page-Id: {top}"]
    lines += ["Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def _lines(chunk: int):
    """The archive's lines, without their line feeds: headers, the payload piece by piece, the end of the record."""

    def run(batches):
        held, size = [], 0
        line = bytearray()

        def full() -> bool:
            nonlocal size
            size += len(held[-1]) + 100
            return size > chunk

        def out():
            nonlocal held, size
            rows, held, size = held, [], 0
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

        for batch in batches:
            for page_id, url, html, digest, top in zip(*(batch.column(i) for i in range(5))):
                page_id, url, digest, top = page_id.as_py(), url.as_py(), digest.as_py(), top.as_py()
                payload = memoryview(html.as_buffer() or b"")
                revisit = top is not None and top != page_id
                coded = not revisit and far_apart(payload, chunk)
                head, http = _head(page_id, url, digest, len(payload), top, chunk if coded else 0)
                held += head.split(b"\n")[:-1] + http.split(b"\n")[:-1]
                for at in range(0, 0 if revisit else len(payload), chunk):
                    piece = bytes(payload[at : at + chunk])
                    if coded:
                        piece = f"{len(piece):x}\r\n".encode() + piece + b"\r\n"
                    first, *more = piece.split(b"\n")
                    line += first
                    for x in more:
                        held.append(bytes(line))
                        line[:] = x
                        if full():
                            yield out()
                if coded:
                    held += [b"0\r", b"\r"]
                held += [bytes(line) + b"\r", b"\r"]
                line.clear()
                size += 600
                if full():
                    yield out()
        if held:
            yield out()

    return run


def write_warc(pages: DataFrame, path: str, least: int = LEAST, chunk: int = CHUNK) -> None:
    """Write a record for each row of ``pages`` (``page_id``, ``url``, ``html``) under ``path``."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    equal = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    equal = written(equal, "warc-equal")
    marked = rows.join(small(equal), ["digest", "bytes"], "left").select("page_id", "url", "payload", "digest", "top")
    lines = marked.mapInArrow(_lines(chunk), "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", "\n").text(path)


class _Reader:
    """Takes an archive's lines, gives a row for each chunk of a payload."""

    def __init__(self, chunk: int, data: bool):
        self.chunk, self.data, self.state, self.rows = chunk, data, "between", []

    def line(self, line: bytes) -> None:
        if self.state == "block":
            self.block(line)
        elif self.state == "between":
            if line.startswith(b"WARC/"):
                self.state, self.head = "head", {}
        elif line.strip(b"\r"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.head[name.strip().lower()] = value.strip()
        else:
            self.left = int(self.head.get("content-length", 0))
            self.http, self.in_http = {}, "http" in self.head.get("content-type", "")
            self.part, self.no, self.size, self.sha = bytearray(), 0, 0, hashlib.sha1()
            self.coded, self.due = False, None
            self.state = "block"
            if not self.left:
                self.end()

    def block(self, line: bytes) -> None:
        piece = (line + b"\n")[: self.left]
        self.left -= len(piece)
        if self.in_http:
            if text := line.strip(b"\r"):
                name, _, value = text.decode("utf-8", "replace").partition(":")
                self.http[name.strip().lower()] = value.strip()
            else:
                self.in_http = False
                self.coded = "chunked" in self.http.get("transfer-encoding", "").lower()
        elif self.coded:
            self.decode(piece)
        else:
            self.take(piece)
        if not self.left:
            self.end()

    def decode(self, piece: bytes) -> None:
        """A line of a payload in chunked transfer coding: the size of a chunk, or some of it and the line's end after it."""
        if self.due is None:
            if size := piece.split(b";")[0].strip():
                self.due = int(size, 16) or None
            return
        self.take(piece[: self.due])
        self.due -= min(self.due, len(piece))
        # What follows a chunk is an empty line, or the rest of this one; a size comes next.
        if not self.due:
            self.due = None

    def take(self, piece: bytes) -> None:
        self.part += piece
        while len(self.part) > self.chunk:
            self.give(bytes(self.part[: self.chunk]), False)
            del self.part[: self.chunk]

    def give(self, data: bytes, last: bool) -> None:
        self.size += len(data)
        self.sha.update(data)
        h, kind = self.head, self.head.get("warc-type", "")
        number = lambda key: int(h[key]) if key in h else None
        said = h.get("warc-payload-digest", "").partition(":")[2]
        said = base64.b32decode(said).hex() if said else None
        revisit = kind == "revisit"
        size, sha = (int(self.http.get("content-length", 0)), said) if revisit else (self.size, self.sha.hexdigest())
        if last and not revisit and said and said != sha:
            raise ValueError(f"payload of {h.get('warc-record-id')} is damaged: {sha} is not {said}")
        self.rows.append((h.get("warc-record-id"), kind, h.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page-id"), self.no, data if self.data else None, sha, size, last))
        self.no += 1

    def end(self) -> None:
        self.give(bytes(self.part), True)
        self.state, self.part = "between", bytearray()


SCHEMA = "record_id string, record_type string, url string, page_id long, refers_to long, chunk_no int, data binary, sha1_so_far string, bytes_so_far long, last boolean"


def read_warc(spark: SparkSession, path: str, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """Chunk rows of the gzip archives under ``path``: ``SCHEMA``. ``data`` False leaves the bytes out."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]

    def rows(reader):
        held, reader.rows = reader.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    def run(batches):
        reader = _Reader(chunk, data)
        for batch in batches:
            for line in batch.column(0):
                reader.line(line.as_py())
                if len(reader.rows) >= (16 if data else 4096):
                    yield rows(reader)
            if reader.rows:
                yield rows(reader)

    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary")).mapInArrow(run, SCHEMA)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), t AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to
FROM (SELECT *, strlen(h) >= {LEAST} AND page_id <> top AS again FROM p JOIN t USING (h))
"""
