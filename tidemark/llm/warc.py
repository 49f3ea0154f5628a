"""WARC writing and sequential reading, one gzip member for each record.

``write_archives`` turns a table of pages into archives; ``read_archives`` reads them
back. Of rows with equal payloads of at least ``MIN_REVISIT`` bytes the one with the
smallest page id is a response and the others are revisits that refer to it.

Defined cases: null html is an empty payload; null urls are written as empty; rows
that repeat the smallest page id with the same payload are all responses; a null
page id is never the one referred to unless all ids of the payload are null (then
all are responses); an empty table gives no archive and no row; further columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import store

MIN_REVISIT = 100
READ_BLOCK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


class WarcError(ValueError):
    """An archive breaks the framing or a digest."""


@dataclass
class Record:
    """A record as read: headers by lower-case name, HTTP head, payload's length and digest, payload if kept."""

    headers: dict[str, str]
    http_head: bytes = b""
    payload_bytes: int = 0
    payload_digest: str = ""
    payload: bytes | None = None
    fields: dict[str, str] = field(default_factory=dict)


def page_urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def urn_page(urn: str | None):
    found = re.fullmatch(r"<urn:page:(-?\d+|null)>", urn or "")
    return None if not found or found[1] == "null" else int(found[1])


def _clean(value) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {page_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


class _Framer:
    """Takes a record's decompressed bytes piece by piece; holds its heads, and the payload only if asked to."""

    def __init__(self, keep_payload: bool):
        self.keep, self.head, self.record, self.left = keep_payload, b"", None, 0
        self.http, self.tail, self.size = b"", b"", 0
        self.block_hash, self.payload_hash, self.parts = hashlib.sha256(), hashlib.sha256(), []
        self.in_payload = False

    def feed(self, data: bytes) -> None:
        if self.record is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise WarcError(f"no WARC version line: {lines[0][:40]!r}")
            self.record = Record({k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])})
            self.left = int(self.record.headers["content-length"])
            data, self.head = self.head[end + 4 :], b""
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.block_hash.update(block)
        if not self.in_payload:
            self.http += block
            end = self.http.find(b"\r\n\r\n")
            block = b""
            if end >= 0:
                self.in_payload, block, self.http = True, self.http[end + 4 :], self.http[:end]
        if self.in_payload:
            self.size += len(block)
            self.payload_hash.update(block)
            if self.keep:
                self.parts.append(block)
        self.tail += rest
        if len(self.tail) > 4:
            raise WarcError("bytes beyond the record's Content-Length")

    def close(self) -> Record:
        r = self.record
        if r is None or self.left or self.tail != b"\r\n\r\n":
            raise WarcError("a record ends before its Content-Length")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in self.http.decode("utf-8").split("\r\n")[1:])}
        r.http_head, r.fields = self.http, fields
        want = r.headers.get("warc-block-digest", "").removeprefix("sha256:")
        if want and want != self.block_hash.hexdigest():
            raise WarcError("the block digest differs")
        if r.headers["warc-type"] == "revisit":
            if self.size:
                raise WarcError("a revisit with a payload")
            r.payload_bytes = int(fields["content-length"])
            r.payload_digest = r.headers["warc-payload-digest"].removeprefix("sha256:")
        else:
            r.payload_bytes, r.payload_digest = self.size, self.payload_hash.hexdigest()
            if r.payload_digest != r.headers["warc-payload-digest"].removeprefix("sha256:"):
                raise WarcError("the payload digest differs")
            r.payload = b"".join(self.parts) if self.keep else None
        return r


def read_records(stream, keep_payload: bool = False, block: int = READ_BLOCK) -> Iterator[Record]:
    """Records of an archive in order: reads block by block, inflates piece by piece, a gzip member for each record."""
    inflate, framer, fed = zlib.decompressobj(31), _Framer(keep_payload), False
    data = stream.read(block)
    while data:
        piece = inflate.decompress(data, block)
        fed = True
        if piece:
            framer.feed(piece)
        if inflate.eof:
            yield framer.close()
            data = inflate.unused_data or stream.read(block)
            inflate, framer, fed = zlib.decompressobj(31), _Framer(keep_payload), False
        else:
            data = inflate.unconsumed_tail or stream.read(block)
    if fed:
        while piece := inflate.decompress(inflate.unconsumed_tail, block):
            framer.feed(piece)
        if not inflate.eof:
            raise WarcError("the last gzip member is cut off")
        yield framer.close()


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, and refers_to and is_revisit by the rule above.

    Only payloads that occur more than once reach the table of originals; it is written
    first, so its size is known to the join: small ones are broadcast by Spark's own
    threshold, large ones meet in a sort-merge join whose hot digests AQE splits.
    """
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    again = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    again = store.table(again.where("n > 1 and first_id is not null").select(F.col("digest").alias("of_digest"), "first_id"), "warc-first")
    joined = rows.join(again, rows.digest == again.of_digest, "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("is_revisit"))


def write_archives(pages: DataFrame, folder: str) -> list:
    """An archive for each task with rows; the manifest rows (path, records, bytes) of the attempts that count."""

    def write(batches):
        path, out, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "is_revisit")), strict=True):
                page_id, url, html, digest, refers_to, revisit = row
                data = record_bytes(page_id, url, html.encode("utf-8"), digest, refers_to, revisit)
                out = out or store.open_out(path)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return [tuple(r) for r in with_roles(pages).mapInArrow(write, MANIFEST).collect()]


def read_archives(spark: SparkSession, manifest: list) -> DataFrame:
    """A row for each record of the listed archives, every digest and length verified on the way."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def read(batches):
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                seen, rows = 0, []
                with store.open_in(path) as stream:
                    for r in read_records(stream):
                        kind = r.headers["warc-type"]
                        rows.append((urn_page(r.headers["warc-record-id"]), r.payload_bytes, r.payload_digest, kind, urn_page(r.headers.get("warc-refers-to")), r.headers.get("warc-target-uri", "")))
                        seen += 1
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if seen != records:
                    raise WarcError(f"{path} holds {seen} records; its manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return store.manifest_frame(spark, manifest, MANIFEST).mapInArrow(read, RECORDS)
