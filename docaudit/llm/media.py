"""Media columns: content-addressed payloads in tar shards, rows with digest, shard, offset and length.

A payload becomes a PNG image, 8-bit RGB, 64 pixels wide (192 bytes a row), named by its SHA-256. A task stores what it
reads and stores equal payloads once, so payloads are never shuffled; equal ones of different tasks are resolved to one
address when rows meet addresses. Metadata columns come from reading a member's first 33 bytes alone.

Defined results: null text counts as empty (192 spaces); equal texts have equal values; an empty table gives no rows;
repeated rows and rows with one doc_id each have a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_store import _arrow

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a shard after which the next one begins, and digests a task remembers.
SHARD_BYTES, REMEMBERED = 256 << 20, 1 << 17
HEADER_BYTES = 33

ADDRESSES = "digest binary, shard string, offset long, length long"
OBJECTS = "digest binary, shard string, media_offset long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, width long, height long, bit_depth int, color_type int, feature string"


def padded(data: bytes) -> bytes:
    return data + b" " * (ROW * max(1, -(-len(data) // ROW)) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(payload: bytes) -> bytes:
    """A PNG image whose samples are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from an image's first 33 bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIBB", data[16:26])


def decode(data: bytes) -> bytes:
    width, height, _, _ = header(data)
    at, parts = 8, []
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 3 * width + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean colour and a 64-bit difference hash of the payload's samples in 72 equal spans."""
    samples = np.frombuffer(payload, np.uint8)
    colour = "".join(f"{int(c):02x}" for c in samples.reshape(-1, 3).mean(0))
    edges = np.linspace(0, len(samples), 73).astype(np.int64)
    sums = np.add.reduceat(samples.astype(np.int64), edges[:-1]) / np.diff(edges)
    cells = sums.reshape(8, 9)
    return f"rgb:{colour}/dhash:{np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()}"


class _Shard:
    def __init__(self, folder: str, number: int):
        self.file = common.SharedFile(folder, f"media-{common.task_number():06d}-{number:04d}.tar")

    def add(self, digest: bytes, data: bytes) -> int:
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(data)
        self.file.write(info.tobuf(tarfile.USTAR_FORMAT))
        at = self.file.write(data)
        self.file.write(b"\0" * (-len(data) % tarfile.BLOCKSIZE))
        return at

    def close(self) -> None:
        self.file.write(b"\0" * (2 * tarfile.BLOCKSIZE))
        self.file.close()


def _store(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    shard, number, seen, rows = None, 0, OrderedDict(), []
    for batch in batches:
        for text in batch.column("text"):
            payload = padded(text.as_buffer().to_pybytes() if text.is_valid else b"")
            digest = hashlib.sha256(payload).digest()
            if digest in seen:
                seen.move_to_end(digest)
                continue
            seen[digest] = None
            if len(seen) > REMEMBERED:
                seen.popitem(last=False)
            if shard is None:
                shard = _Shard(folder, number)
            data = encode(payload)
            rows.append({"digest": digest, "shard": shard.file.uri, "offset": shard.add(digest, data), "length": len(data)})
            if shard.file.size >= SHARD_BYTES:
                shard.close()
                shard, number = None, number + 1
        if len(rows) > 5000:
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(ADDRESSES))
            rows = []
    if shard:
        shard.close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(ADDRESSES))


def _read(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    name, file = None, None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["shard"] != name:
                fs, path = common.storage(r["shard"])
                name, file = r["shard"], fs.open_input_file(path)
            width, height, depth, kind = header(bytes(file.read_at(HEADER_BYTES, r["offset"])))
            row = {"digest": r["digest"], "shard": r["shard"].rpartition("/")[2], "media_offset": r["offset"], "media_bytes": r["length"], "width": width, "height": height, "bit_depth": depth, "color_type": kind, "payload_bytes": 3 * width * height}
            if full:
                data = bytes(file.read_at(r["length"], r["offset"]))
                payload = decode(data)
                row |= {"payload_sha256": hashlib.sha256(payload).digest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_sha256": hashlib.sha256(data).digest(), "feature": f"png/{width}x{height}/{feature(payload)}"}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(OBJECTS))


def store(texts: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads of texts(text) into tar shards; the address of each distinct one."""
    common.arrow_limits(texts.sparkSession)
    stored = common.written(texts.select("text").mapInArrow(lambda it: _store(it, folder), ADDRESSES), "media-addresses")
    return stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a")).select("digest", "a.*")


def read_media(addresses: DataFrame, full: bool = True) -> DataFrame:
    """Columns of each stored object: from its header's 33 bytes or, if full, from all its bytes."""
    ordered = addresses.repartition("shard", F.floor(F.col("offset") / F.lit(4 << 20))).sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(lambda it: _read(it, full), OBJECTS)


def media_rows(documents: DataFrame, folder: str) -> DataFrame:
    """For each row of documents(doc_id, text): values and features of its payload, read back, and its address (shard, offset, length) and header."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text)
    spaces = (F.greatest(F.lit(1), F.ceil(size / ROW)) * ROW - size).cast("int")
    payload = F.concat(F.encode(text, "UTF-8"), F.encode(F.repeat(F.lit(" "), spaces), "UTF-8"))
    rows = documents.select("doc_id", size.cast("long").alias("n_bytes"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    objects = read_media(store(documents, folder))
    # a digest of many copies is a skewed key of a join, which Spark splits; hashes travel as bytes
    joined = rows.join(objects, "digest")
    return joined.select("doc_id", "n_bytes", "payload_bytes", *[F.lower(F.hex(c)).alias(c) if c.endswith("sha256") else F.col(c) for c in ("payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "media_offset", "width", "height", "bit_depth", "color_type")])
