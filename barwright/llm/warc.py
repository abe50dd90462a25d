"""WARC archives as a table of chunks: (record, chunk, data, digest).

The bytes of a record, put together in the order of its chunks, are a WARC/1.1 record. A payload larger
than a chunk becomes several rows, so neither writing, shuffling nor reading ever builds a whole record;
each row carries the SHA-1 of the payload up to its end, and the reader, which keeps one running digest,
compares the two at every chunk. Of records with equal payloads one is a response, the others are revisits
that refer to it and hold headers only.

A null payload is empty, a null URL is left out, a null id writes an empty one. Rows repeated with the same
id and payload as the response are responses too, so a revisit always refers to another page.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.session import materialize

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record bigint, chunk int, data binary, digest string"
RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, intact boolean"
_BLANK = b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    digits = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def record_head(page_id: int | None, url: str | None, length: int, sha1: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """Everything before the payload: WARC fields, then the HTTP fields that are part of the block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()),
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
        fields.append(("WARC-Target-URI", safe))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + (0 if revisit else length)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + http


def chunks_of(head: bytes, payload: memoryview, chunk_bytes: int) -> Iterator[tuple[int, bytes, str]]:
    """(chunk number, bytes, SHA-1 of the payload so far)."""
    running = hashlib.sha1()
    size = len(payload)
    for k, i in enumerate(range(0, max(size, 1), chunk_bytes)):
        part = payload[i : i + chunk_bytes]
        running.update(part)
        data = b"".join([head if k == 0 else b"", part, _BLANK if i + chunk_bytes >= size else b""])
        yield k, data, running.hexdigest()


def write_archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk_bytes: int = 1 << 18
) -> DataFrame:
    """Writes one record per row to the shared folder and returns the chunk table read from there.

    Of rows with equal payloads of at least ``min_bytes``, the one with the largest id is the response.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    short = rows.select("id", "sha1", F.octet_length("payload").alias("length"))
    equal = short.where(F.col("length") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    equal = materialize(equal.where("n > 1 AND keep IS NOT NULL").select("sha1", "keep"), "equal_payloads")
    planned = rows.join(equal, "sha1", "left").withColumn("record", F.monotonically_increasing_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()), ("digest", pa.string())])
        out, held = [], 0
        for batch in batches:
            ids, urls, keeps, records, digests = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "url", "keep", "record", "sha1"))
            payloads = batch.column(batch.schema.get_field_index("payload"))
            for i, page_id in enumerate(ids):
                body = memoryview(payloads[i].as_buffer())
                revisit = keeps[i] is not None and page_id != keeps[i]
                head = record_head(page_id, urls[i], len(body), bytes.fromhex(digests[i]), keeps[i], revisit)
                for k, data, digest in chunks_of(head, body[:0] if revisit else body, chunk_bytes):
                    out.append((records[i], k, data, digest))
                    held += len(data)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return materialize(planned.select("id", "url", "payload", "sha1", "keep", "record").mapInArrow(write, CHUNKS), "warc")


class _Reader:
    """One record, fed chunk by chunk; holds its head and a running digest."""

    def __init__(self) -> None:
        self.head: bytes | None = b""
        self.running = hashlib.sha1()
        self.seen = 0
        self.left = 0
        self.chunks = 0
        self.intact = True
        self.fields: dict[str, str] = {}
        self.full = 0

    def feed(self, chunk: int, data: bytes, digest: str) -> None:
        self.intact &= chunk == self.chunks
        self.chunks += 1
        body = memoryview(data)
        if self.head is not None:
            self.head += data
            first = self.head.find(_BLANK)
            second = self.head.find(_BLANK, first + 4) if first >= 0 else -1
            if second < 0:
                return
            lines = self.head[:first].decode().split("\r\n")
            self.intact &= lines[0] == "WARC/1.1"
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            http = dict(line.split(": ", 1) for line in self.head[first + 4 : second].decode().split("\r\n")[1:])
            self.full = int(http["Content-Length"])
            self.left = int(self.fields["Content-Length"]) - (second - first)
            body = memoryview(self.head)[second + 4 :]
            self.head = None
        part, rest = body[: self.left], body[self.left :]
        self.running.update(part)
        self.left -= len(part)
        self.seen += len(part)
        self.intact &= self.running.hexdigest() == digest and _BLANK.startswith(bytes(rest))

    def record(self) -> tuple:
        told = self.fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        revisit = self.fields.get("WARC-Type") == "revisit"
        found = base64.b32encode(self.running.digest()).decode()
        whole = self.head is None and self.left == 0 and (revisit or (found == told and self.seen == self.full))
        refers = self.fields.get("WARC-Refers-To")
        return (
            _number(self.fields.get("WARC-Record-ID", "")) if self.fields else None,
            self.fields.get("WARC-Target-URI"),
            self.fields.get("WARC-Type"),
            self.full if revisit else self.seen,
            told if revisit else found,
            _number(refers) if refers else None,
            self.intact and whole,
        )


def read_archive(chunks: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, intact) of every record.

    Size and digest of a response come from the bytes read, those of a revisit from its headers. ``intact``
    is false where a chunk is missing, out of place or altered.
    """
    ordered = chunks.repartition("record").sortWithinPartitions("record", "chunk")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        names = [c.split()[0] for c in RECORDS.split(", ")]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        current, reader, out = None, None, []
        for batch in batches:
            data = batch.column(2)
            for i, (record, chunk, digest) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                if record != current:
                    if reader:
                        out.append(reader.record())
                    current, reader = record, _Reader()
                reader.feed(chunk, data[i].as_py(), digest)
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        if reader:
            out.append(reader.record())
        if out:
            yield batch_of(out)

    return ordered.select("record", "chunk", "data", "digest").mapInArrow(read, RECORDS)
