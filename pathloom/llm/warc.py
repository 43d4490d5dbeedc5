"""WARC archives as chunked record tables.

An archive is a table of rows (archive, record, chunk, data, ...): the concatenation of ``data`` in that order is a WARC/1.1
file. The first chunk of a record is its header, further ones hold at most ``CHUNK`` bytes of the block, so no step allocates
a record as a whole beyond the row that it came from. Each row also carries the digest of the payload so far. Reading is a
parser that gets chunks one after another in sorted partitions and keeps one record's header and digest state only; each
chunk's digest is checked as the chunk arrives, so a broken chunk names itself.

Of records with equal payloads, the one with the largest page id is a response, the others are revisits without payload.

Defined cases: null html is an empty payload; rows that share the largest id of a payload are all responses; a null page id
comes after every other; payloads below ``min_bytes`` are always responses; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, materialize

CHUNK = 64 * 1024
#: Up to so many groups of equal payloads (about 60 bytes each) are broadcast; beyond, they are joined by shuffle.
FEW_GROUPS = 50_000
CHUNKS = "archive int, record long, chunk int, data binary, payload_so_far string"
_PAGE = "urn:pathloom:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _header(page_id, url: str, digest: str, size: int, refers_to, revisit: bool) -> bytes:
    """The WARC header of a record and the HTTP header that begins its block."""
    http = _HTTP.format(size).encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_PAGE}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(url.split()) or "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_PAGE}{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else size))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + http


def write(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html) -> the chunk table, in the shared folder."""
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    equal = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("sha", "response")
    equal = materialize(equal, "equal-payloads")
    if equal.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        equal = F.broadcast(equal)
    rows = rows.join(equal, "sha", "left").select("page_id", "url", "payload", "response", F.unhex("sha").alias("sha"))

    def run(batches):
        from pyspark import TaskContext

        archive, record = TaskContext.get().partitionId(), -1
        out: list[tuple] = []
        held = 0
        for b in batches:
            for page_id, url, payload, response, whole in zip(*(c for c in b.columns), strict=True):
                payload, page_id, response = payload.as_buffer(), page_id.as_py(), response.as_py()
                record += 1
                view = memoryview(payload)
                digest = _b32(whole.as_py())
                revisit = response is not None and response != page_id
                out.append((archive, (archive << 40) + record, 0, _header(page_id, url.as_py(), digest, len(view), response, revisit), None))
                sha, body = hashlib.sha1(), b"" if revisit else view
                for k, at in enumerate(range(0, len(body), CHUNK), 1):
                    part = bytes(body[at : at + CHUNK])
                    sha.update(part)
                    out.append((archive, (archive << 40) + record, k, part, _b32(sha.digest())))
                    held += len(part)
                    if held > 4_000_000:
                        yield _chunks(out)
                        out, held = [], 0
                out.append((archive, (archive << 40) + record, 1 << 30, b"\r\n\r\n", None))
                if len(out) > 4000:
                    yield _chunks(out)
                    out, held = [], 0
        yield _chunks(out)

    return materialize(arrow(rows, run, CHUNKS), "warc")


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string())
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["archive", "record", "chunk", "data", "payload_so_far"])


class Parser:
    """Takes a record's bytes in any portions; keeps the header and digest state only."""

    def __init__(self):
        self.head, self.fields, self.http, self.left, self.sha, self.size, self.tail = b"", None, None, 0, hashlib.sha1(), 0, b""

    def check(self, chunk: int, so_far: str | None) -> None:
        """Holds the payload read so far against the chunk's own digest."""
        if so_far is not None and so_far != _b32(self.sha.copy().digest()):
            raise ValueError(f"record {self.fields and self.fields['warc-record-id']}: chunk {chunk} has another digest")

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            if b"\r\n\r\n" not in self.head:
                return
            head, _, data = self.head.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            if first != "WARC/1.1":
                raise ValueError(f"no WARC record: {first[:40]!r}")
            self.fields, self.head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, b""
            self.left = int(self.fields["content-length"])
        block, rest = data[: self.left], data[self.left :]
        self.left -= len(block)
        if self.http is None and block:
            self.head += block
            if b"\r\n\r\n" in self.head:
                http, _, block = self.head.partition(b"\r\n\r\n")
                self.http, self.head = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, b""
            else:
                block = b""
        self.sha.update(block)
        self.size += len(block)
        self.tail += rest

    def close(self) -> dict:
        """page_id, payload_bytes, payload_digest, record_type, refers_to. Checks lengths, the record's end and the digest."""
        f, ref = self.fields, None
        said = f["warc-payload-digest"].removeprefix("sha1:")
        if self.left or self.tail != b"\r\n\r\n":
            raise ValueError(f"record {f['warc-record-id']} is cut or longer than its length")
        if f["warc-type"] == "revisit":
            ref = int(f["warc-refers-to"][1:-1].removeprefix(_PAGE))
        elif said != _b32(self.sha.digest()) or self.size != int(self.http["content-length"]):
            raise ValueError(f"record {f['warc-record-id']} has another digest or length")
        page = f["warc-record-id"][1:-1].removeprefix(_PAGE)
        return {"page_id": int(page) if page else None, "payload_bytes": int(self.http["content-length"]), "payload_digest": said, "record_type": f["warc-type"], "refers_to": ref}


def read(chunks: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    rows = chunks.select("record", "chunk", "data", "payload_so_far").repartition("record").sortWithinPartitions("record", "chunk")

    def run(batches):
        record, parser, done = None, None, []
        for b in batches:
            for r, chunk, data, so_far in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if r != record:
                    if parser:
                        done.append(parser.close())
                    record, parser = r, Parser()
                parser.feed(bytes(data.as_buffer()))
                parser.check(chunk, so_far)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
        if parser:
            done.append(parser.close())
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return arrow(rows, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(chunks: DataFrame, archive: int) -> Iterator[bytes]:
    """One archive as the members of a .warc.gz file, chunk by chunk through the driver (for hand-over of single files)."""
    record, data = None, []
    for r in chunks.where(F.col("archive") == archive).select("record", "chunk", "data").orderBy("record", "chunk").toLocalIterator():
        if r.record != record and data:
            yield gzip.compress(b"".join(data), mtime=0)
            data = []
        record = r.record
        data.append(bytes(r.data))
    if data:
        yield gzip.compress(b"".join(data), mtime=0)
