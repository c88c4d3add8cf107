"""WARC archives as a chunked record table.

write_archives() gives each row a response or, if a later page has the same payload, a revisit record, one gzip member
each. read_chunks() streams archives into rows of (record id, chunk number): a payload passes in chunks of CHUNK bytes, each
with the digest and the length of all up to it, so that no record is ever whole in memory.

Defined results: null html is an empty payload; of rows with equal payloads those with the largest page_id (null below
all) are responses, also when that row is repeated; an empty table gives no archive and no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_store import _arrow

CHUNK = 256 << 10
#: Compressed bytes after which an archive ends.
ARCHIVE_BYTES = 64 << 20
MANIFEST = "path string, records long, bytes long"
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, url string, chunk_no long, chunk binary, total_bytes long, digest_so_far string, last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _field(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    name = record_id[len("<urn:x-page:") : -1]
    return None if name == "none" else int(name)


class _Archive:
    """One gzip member a record."""

    def __init__(self, folder: str, number: int):
        self.file, self.records = common.SharedFile(folder, f"pages-{common.task_number():06d}-{number:04d}.warc.gz"), 0

    def add(self, fields: list[tuple[str, str]], block: list) -> None:
        size = sum(len(x) for x in block)
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(size))]) + "\r\n"
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        for part in (head.encode(), *block, b"\r\n\r\n"):
            for at in range(0, len(part), CHUNK):
                if data := squeeze.compress(part[at : at + CHUNK]):
                    self.file.write(data)
        self.file.write(squeeze.flush())
        self.records += 1

    def close(self) -> dict:
        self.file.close()
        return {"path": self.file.uri, "records": self.records, "bytes": self.file.size}


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    archive, number, done = None, 0, []
    for batch in batches:
        for page_id, url, html, digest, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
            if archive is None:
                archive = _Archive(folder, number)
            page_id, refers = page_id.as_py(), refers.as_py()
            payload = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            fields = [
                ("WARC-Type", "response" if refers is None else "revisit"),
                ("WARC-Record-ID", _record_id(page_id)),
                ("WARC-Date", "1970-01-01T00:00:00Z"),
                *([("WARC-Target-URI", _field(url.as_py()))] if url.is_valid else []),
                ("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(digest.as_py()))}"),
                *([("WARC-Refers-To", _record_id(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers is not None else []),
                ("Content-Type", "application/http;msgtype=response"),
            ]
            archive.add(fields, [http] if refers is not None else [http, payload])
            if archive.file.size >= ARCHIVE_BYTES:
                done.append(archive.close())
                archive, number = None, number + 1
    if archive:
        done.append(archive.close())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=_arrow(MANIFEST))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Archives of pages(page_id, url, html) in the folder; a manifest row for each. Payloads below least_bytes are always responses."""
    common.arrow_limits(pages.sparkSession)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("digest", F.sha1(body))
    shared = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    # digests and ids alone meet here; only those that occur twice come back
    latest = keyed.where(shared).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = keyed.join(latest, "digest", "left")
    refers = F.when(shared & F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest"))
    return common.written(joined.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(lambda it: _write(it, folder), MANIFEST), "warc-manifest")


class _Stream:
    """The bytes of an archive, inflated a bounded part at a time."""

    def __init__(self, source):
        self.source, self.inflate, self.rest, self.buffer, self.end = source, zlib.decompressobj(31), b"", b"", False

    def more(self) -> bool:
        while not self.end:
            if not self.rest:
                self.rest = self.source.read(CHUNK)
                if not self.rest:
                    self.end = True
                    return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            data = self.inflate.decompress(self.rest, CHUNK)
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if data:
                self.buffer += data
                return True
        return False

    def head(self) -> bytes | None:
        """Up to an empty line; None at the end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("archive is cut short")
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + 4 :]
        return out

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("archive is cut short")
            out, self.buffer = self.buffer[: min(n, CHUNK)], self.buffer[min(n, CHUNK) :]
            n -= len(out)
            yield out


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def records(source, with_payload: bool) -> Iterator[dict]:
    """Chunk rows of one archive."""
    stream = _Stream(source)
    while (head := stream.head()) is not None:
        warc = _fields(head)
        http_head = stream.head()
        http = _fields(http_head)
        left = int(warc["Content-Length"]) - len(http_head) - 4
        row = {"record_id": warc["WARC-Record-ID"], "page_id": _page_id(warc["WARC-Record-ID"]), "record_type": warc["WARC-Type"], "refers_to": None, "url": warc.get("WARC-Target-URI")}
        declared = warc["WARC-Payload-Digest"].removeprefix("sha1:")
        if row["record_type"] == "revisit":
            yield row | {"refers_to": _page_id(warc["WARC-Refers-To"]), "chunk_no": 0, "chunk": None, "total_bytes": int(http["Content-Length"]), "digest_so_far": declared, "last": True}
        else:
            digest, total, number = hashlib.sha1(), 0, 0
            for chunk in stream.body(left) if left else (b"",):
                digest.update(chunk)
                total += len(chunk)
                last = total == left
                so_far = base32(digest.digest())
                if last and so_far != declared:
                    raise ValueError(f"{row['record_id']}: its payload has digest {so_far}, not {declared}")
                yield row | {"chunk_no": number, "chunk": chunk if with_payload else None, "total_bytes": total, "digest_so_far": so_far, "last": last}
                number += 1
        if b"".join(stream.body(4)) != b"\r\n\r\n":
            raise ValueError(f"{row['record_id']}: no end of record")


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, name = common.storage(path)
            rows, held = [], 0
            with fs.open_input_stream(name, compression=None) as source:
                for row in records(source, with_payload):
                    rows.append(row)
                    held += len(row["chunk"] or b"") + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(CHUNKS))
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(CHUNKS))


def read_chunks(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The chunked record table of all archives."""
    paths = sorted((r.path,) for r in manifest.select("path").collect())  # one for each archive
    return common.one_task_each(spark, paths, "path string", "path").mapInArrow(lambda it: _read(it, with_payload), CHUNKS)
