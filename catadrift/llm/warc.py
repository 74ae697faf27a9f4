"""WARC archives: written by Spark with one gzip member per record, read back sequentially.

Writing: of records with equal payloads of at least `min_bytes` bytes the smallest id is the response, the others revisit
it and hold no payload. Records go to files through Spark's text sink, so the output commit of the cluster's file system
holds: a lost executor leaves no half archive. The sink ends each value with a separator, for which the members' last byte
serves: it is 0 for all members below 16 MB, and behind a larger one stands an empty member, which gzip readers skip.

Reading: a file is read once from front to back. Each member is inflated piece by piece; the record's headers come first,
then exactly Content-Length bytes, which pass through SHA-256 as they come and are compared with the digests in the
headers. A record whose framing or digest is wrong is an error.

Edge cases: a null payload is empty; a null id or address is left out of the headers and read as null; rows that share the
smallest id of a payload are all responses; line breaks and other control characters in an address are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 100
#: Bytes of a compressed file that are fed to the inflater at a time.
FEED = 1 << 16
DATE = "2000-01-01T00:00:00Z"
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(number: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A WARC record; a revisit if `first` names another record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    if number is not None:
        head.append(f"WARC-Record-ID: <urn:x-page:{number}>")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{first}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    """A gzip member that ends with a zero byte."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(content) + packer.flush()
    return out if out[-1] == 0 else out + EMPTY


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES,
    records_per_file: int = 100_000,
) -> None:
    """Write the archives; path must not exist."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    slim = pages.select(F.col(key).cast("long").alias("id"), F.octet_length(body).alias("size"), F.sha2(body, 256).alias("digest"))
    firsts = slim.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(firsts.drop("n"), "digest", "left").select("id", "url", "body", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                done = [member(record(*x))[:-1] for x in zip(*(part.column(c).to_pylist() for c in ("id", "url", "body", "digest", "first")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["member"])

    members = rows.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\x00").option("maxRecordsPerFile", records_per_file).text(path)


class Inflater:
    """The bytes of one gzip member after another, a bounded piece at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.rest = memoryview(data), 0, b""
        self.unpacker = None

    def next_member(self) -> bool:
        """Whether another member begins."""
        if self.at >= len(self.data):
            return False
        self.unpacker, self.rest = zlib.decompressobj(31), b""
        return True

    def more(self) -> bool:
        """Inflate a further piece; False at the end of the member."""
        while not self.unpacker.eof:
            piece = self.unpacker.unconsumed_tail or self.data[self.at : self.at + FEED]
            if not len(piece):
                raise ValueError("the archive ends inside a record")
            if not self.unpacker.unconsumed_tail:
                self.at += len(piece)
            out = self.unpacker.decompress(piece, FEED)
            if self.unpacker.eof:
                self.at -= len(self.unpacker.unused_data)
            if out:
                self.rest += out
                return True
        return False

    def line_block(self) -> bytes:
        """Up to and without the next empty line; the whole member if it has none."""
        while (end := self.rest.find(b"\r\n\r\n")) < 0:
            if not self.more():
                out, self.rest = self.rest, b""
                return out
        out, self.rest = self.rest[:end], self.rest[end + 4 :]
        return out

    def exactly(self, size: int) -> Iterator[bytes]:
        """The next `size` bytes, in pieces."""
        while size:
            if not self.rest and not self.more():
                raise ValueError("the record is shorter than its Content-Length")
            piece, self.rest = self.rest[:size], self.rest[size:]
            size -= len(piece)
            yield piece


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _number(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def read_records(data: bytes) -> Iterator[dict]:
    """The records of one archive, framing and digests checked."""
    source = Inflater(data)
    while source.next_member():
        start = source.line_block()
        if not start:  # an empty member
            continue
        if not start.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = headers(start)
        block = hashlib.sha256()
        payload, http, pending = bytearray(), None, b""
        for piece in source.exactly(int(head["content-length"])):
            block.update(piece)
            if http is None:
                pending += piece
                if (end := pending.find(b"\r\n\r\n")) >= 0:
                    http, piece = headers(pending[:end]), pending[end + 4 :]
                else:
                    continue
            payload += piece
        tail = b"".join(source.exactly(4))
        if tail != b"\r\n\r\n" or source.more() or source.rest:
            raise ValueError("the record's length is wrong")
        told = head["warc-payload-digest"].removeprefix("sha256:")
        revisit = head["warc-type"] == "revisit"
        if head["warc-block-digest"] != f"sha256:{block.hexdigest()}" or not revisit and hashlib.sha256(payload).hexdigest() != told:
            raise ValueError("a digest doesn't match")
        size = int(http["content-length"])
        if not revisit and size != len(payload):
            raise ValueError("the payload's length is wrong")
        yield {
            "id": _number(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
            "refers_to": _number(head.get("warc-refers-to")), "payload_bytes": size, "payload_digest": told, "payload": None if revisit else bytes(payload),
        }


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives below path. With payload=False the payloads are checked but not returned."""
    kinds = pa.schema([
        ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for row in read_records(data.as_buffer()):
                    if not payload:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 4096 or size >= 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, ROWS)


def query(spark, sf_dir: str) -> DataFrame:
    from .frames import scratch

    path = scratch(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path, payload=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
