"""WARC: records as gzip members, written by tasks and read back one record after the other."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: an archive is closed when it has this many bytes
ARCHIVE_BYTES = 8 << 20
#: compressed bytes that the reader takes at once
READ_BYTES = 64 << 10
#: a record's named fields may take this many bytes
HEADER_BYTES = 1 << 20

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEADER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

ARCHIVES = "archive string, content binary"
RECORDS = (
    "archive string, record_id string, record_type string, target_uri string, payload_bytes long, "
    "payload_digest string, refers_to string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_originals(pages: DataFrame, key: str, payload: str, least: int = 0) -> DataFrame:
    """``key, payload`` (null as empty) and ``original``: of equal payloads of ``least`` bytes or more, the largest key.

    Equal payloads are found by SHA-1 and length on narrow rows, so a payload that a third of the rows share costs
    one row for each task; the payloads move once, by key.  Rows with the largest key itself, also repeated
    ones, and payloads under ``least`` have a null ``original``.
    """
    rows = pages.select(key, payload, *[c for c in ("url",) if c in pages.columns]).withColumn(payload, F.coalesce(payload, F.lit("")))
    digest = [F.sha1(payload).alias("_sha1"), F.octet_length(payload).alias("_size")]
    narrow = rows.select(key, *digest)
    largest = narrow.where(F.col("_size") >= least).groupBy("_sha1", "_size").agg(F.max(key).alias("_largest"), F.count("*").alias("_n")).where("_n > 1")
    later = narrow.join(largest, ["_sha1", "_size"]).where(~F.col(key).eqNullSafe(F.col("_largest")) & F.col("_largest").isNotNull())
    later = later.select(F.col(key).alias("_key"), F.col("_sha1").alias("_later"), "_largest").distinct()
    match = rows[key].eqNullSafe(later["_key"]) & (F.sha1(rows[payload]) == later["_later"])
    return rows.join(later, match, "left").select(*rows.columns, F.col("_largest").alias("original"))


def _fields(pairs: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1"] + [f"{k}: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', v) if k == 'WARC-Target-URI' else v}" for k, v in pairs if v is not None]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def record(name, url: str | None, payload: bytes, original, date: str) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit of ``original``."""
    digest = base32_sha1(payload)
    block = HTTP_HEADER + (payload if original is None else b"")
    fields = [
        ("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if name is None else name}>"),
        ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("WARC-Profile", None if original is None else REVISIT_PROFILE), ("WARC-Refers-To", None if original is None else f"<urn:page:{original}>"),
        ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_fields(fields) + block + b"\r\n\r\n") + packer.flush()


def write_archives(rows: DataFrame, key: str, payload: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``archive, content``: the rows of ``with_originals`` as archives of about ``ARCHIVE_BYTES``.

    One record for each row, in the order in which its task has them; no rows give no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size, members = TaskContext.get().partitionId(), 0, 0, []

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{task:06d}-{number:05d}.warc.gz"], "content": [b"".join(members)]})

        for batch in batches:
            urls = batch.column("url").to_pylist() if "url" in batch.schema.names else [None] * batch.num_rows
            for name, url, text, original in zip(batch.column(key), urls, batch.column(payload), batch.column("original"), strict=True):
                members.append(record(name.as_py(), url, text.as_py().encode(), original.as_py(), date))
                size += len(members[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    number, size, members = number + 1, 0, []
        if members:
            yield archive()

    return rows.mapInArrow(write, ARCHIVES)


class _Member:
    """The bytes of the gzip members of an archive, one member at a time, a little at a time."""

    def __init__(self, content: memoryview):
        self.content, self.at = content, 0

    def begin(self) -> bool:
        if self.at >= len(self.content):
            return False
        self.unpacker, self.ready = zlib.decompressobj(31), b""
        return True

    def more(self) -> bytes:
        """The next bytes of this member, none after its end."""
        while not self.unpacker.eof:
            taken = self.content[self.at : self.at + READ_BYTES]
            if not len(taken):
                raise ValueError("the archive ends within a record")
            got = self.unpacker.decompress(taken)
            self.at += len(taken) - len(self.unpacker.unused_data)
            if got:
                return got
        return b""


def read_records(content, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive in order; payloads are digested as they come and kept only on request.

    Each record is one gzip member and ``Content-Length`` frames its block.  A block or payload that does not
    have its digest, a wrong frame and a cut archive raise ValueError.
    """
    source = _Member(memoryview(content))
    while source.begin():
        head = b""
        while b"\r\n\r\n" not in head:
            got = source.more()
            if not got or len(head) > HEADER_BYTES:
                raise ValueError("a record without the end of its fields")
            head += got
        head, _, waiting = head.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {first[:40]}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        left, block, body, before = int(fields["content-length"]), hashlib.sha1(), hashlib.sha1(), b""
        size, kept, in_body, tail = 0, [], False, b""
        while True:
            part, over = waiting[:left], waiting[left:]
            left, tail = left - len(part), tail + over
            block.update(part)
            if not in_body:  # the HTTP header goes up to its empty line
                before += part
                end = before.find(b"\r\n\r\n")
                in_body, part = end >= 0, before[end + 4 :] if end >= 0 else b""
            if in_body and part:
                body.update(part)
                size += len(part)
                if payloads:
                    kept.append(part)
            waiting = source.more()
            if not waiting:
                break
        if left or tail != b"\r\n\r\n":
            raise ValueError("a record's length is not its Content-Length")
        told = {k: fields[k].removeprefix("sha1:") for k in ("warc-block-digest", "warc-payload-digest") if k in fields}
        revisit, digest = fields["warc-type"] == "revisit", base64.b32encode(body.digest()).decode()
        if told.get("warc-block-digest", d := base64.b32encode(block.digest()).decode()) != d:
            raise ValueError("a block does not have its digest")
        if not revisit and told.get("warc-payload-digest", digest) != digest:
            raise ValueError("a payload does not have its digest")
        yield {
            "record_id": fields.get("warc-record-id"), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"),
            "payload_bytes": int(fields["warc-payload-length"]) if revisit and "warc-payload-length" in fields else size,
            "payload_digest": told.get("warc-payload-digest") if revisit else digest,
            "refers_to": fields.get("warc-refers-to"), "payload": b"".join(kept) if payloads and not revisit else None,
        }


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of ``archive, content`` rows (as written here, or renamed from Spark's ``binaryFile`` source).

    A null or empty content has no records; a damaged archive fails the job, naming what is wrong.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in (
            "archive", "record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload")])
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                rows, size = [], 0
                for got in read_records(content.as_buffer() if content.is_valid else b"", payloads):
                    rows.append(got | {"archive": name.as_py()})
                    size += len(got["payload"] or b"")
                    if len(rows) == 4096 or size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return archives.mapInArrow(read, RECORDS)
