"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file holds a magic number, the ids (16 bits wide if the vocabulary allows, else 32), and an index at its end: how many
documents have no doc_id (they come first), the others' ascending doc_ids and the boundaries, both as Elias-Fano sequences,
and its length. Boundary i costs about 2 + log2(ids / documents) bits; the select structure finds it without a table of
64-bit offsets.

Defined results: null text counts as empty (its only id is the end id); null doc_ids come first; rows with one doc_id are
ordered by a hash of their text; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"DATOK\x002\n"
#: One select sample for so many set bits.
SAMPLE = 256
#: Bytes of ids read at a time.
BLOCK = 4 << 20

MANIFEST = "path string, first_id long, first_hash long, documents long, ids long, bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence below 2**63 in n * (2 + low_bits) bits and a little."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little")) if n <= SAMPLE else None
        if ones is None:
            counts = np.cumsum(np.bitwise_count(high), dtype=np.int64)
            # samples[j]: the byte that holds set bit j * SAMPLE, and the set bits before that byte
            at = np.searchsorted(counts, np.arange(0, n, SAMPLE), "right")
            self.samples = np.stack([at, np.where(at > 0, counts[at - 1], 0)], 1)
        else:
            self.samples = np.zeros((1, 2), np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = np.zeros(((top >> low_bits) + n + 8) // 8 + 1, np.uint8)
        where = (values >> low_bits) + np.arange(n)
        np.bitwise_or.at(high, where >> 3, (1 << (where & 7)).astype(np.uint8))
        low, step = [], 1 << 16  # so many values at a time; a multiple of 8, so that pieces end on bytes
        for at in range(0, n if low_bits else 0, step):
            bits = ((values[at : at + step, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
            low.append(np.packbits(bits.reshape(-1), bitorder="little"))
        return cls(n, low_bits, np.concatenate(low) if low else np.zeros(0, np.uint8), high)

    def tobytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return out

    def range(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1, read from the nearest select sample on."""
        if b <= a:
            return np.zeros(0, np.int64)
        byte, before = (int(x) for x in self.samples[a // SAMPLE])
        last = int(self.samples[(b - 1) // SAMPLE + 1][0]) + 1 if (b - 1) // SAMPLE + 1 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:last], bitorder="little"))[a - before : b - before] + 8 * byte
        index = np.arange(a, b)
        return ((ones - index) << self.low_bits) | self._low(index)

    def select(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    memo, out = tokens.memo(vocabulary), None
    wide = max(memo.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
    end, kind = np.array([end_id], "<u4").tobytes(), np.dtype("<u4" if wide else "<u2")
    doc_ids, nulls, bounds, first = array("q"), 0, array("q", [0]), None
    waiting, held = [], 0

    def flush() -> None:
        nonlocal held
        if waiting:
            out.write(np.frombuffer(b"".join(waiting), "<u4").astype(kind).tobytes())
        waiting.clear()
        held = 0

    for batch in batches:
        for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
            if out is None:
                out = common.SharedFile(folder, f"ids-{common.task_number():06d}.tok")
                out.write(MAGIC)
                first = (doc_id, key)
            n = 0
            for ids in (*memo.steps(text or ""), end):
                n += len(ids) // 4
                waiting.append(ids)
                held += len(ids)
                if held > BLOCK:
                    flush()
            if doc_id is None:
                nulls += 1
            else:
                doc_ids.append(doc_id)
            bounds.append(bounds[-1] + n)
    if out is None:
        return
    flush()
    keys, documents = _packed(np.array(doc_ids, np.int64)), nulls + len(doc_ids)
    index = struct.pack("<QQ", nulls, len(keys)) + keys + EliasFano.of(np.array(bounds)).tobytes()
    out.write(index + struct.pack("<QQBQ", documents, bounds[-1], kind.itemsize, len(index)) + MAGIC)
    out.close()
    yield pa.RecordBatch.from_pylist([{"path": out.uri, "first_id": first[0], "first_hash": first[1], "documents": documents, "ids": bounds[-1], "bytes": out.size}], schema=_arrow(MANIFEST))


def _packed(ids: np.ndarray) -> bytes:
    """Ascending numbers as parts of a first one and an Elias-Fano sequence of the distances to it, each below 2**62."""
    parts, at = [], 0
    while at < len(ids):
        first = int(ids[at])
        upto = int(np.searchsorted(ids, min(first + (1 << 62), (1 << 63) - 1), "right"))
        data = EliasFano.of(ids[at:upto] - first).tobytes()
        parts.append(struct.pack("<qQ", first, len(data)) + data)
        at = upto
    return b"".join(parts)


def _unpacked(data: bytes) -> list[tuple[int, EliasFano]]:
    """(first number, distances to it) of each part."""
    parts, at = [], 0
    while at < len(data):
        first, n = struct.unpack_from("<qQ", data, at)
        at += struct.calcsize("<qQ")
        parts.append((first, EliasFano.frombytes(data[at : at + n])))
        at += n
    return parts


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


class TokenFile:
    """Random access to one file."""

    TAIL = struct.calcsize("<QQBQ") + len(MAGIC)

    def __init__(self, uri: str):
        fs, path = common.storage(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(self.TAIL, size - self.TAIL)
        if not tail.endswith(MAGIC):
            raise ValueError(f"{uri} is not a token file or is cut short")
        self.documents, self.ids, self.width, n = struct.unpack_from("<QQBQ", tail)
        index = self.file.read_at(n, size - self.TAIL - n)
        self.nulls, n = struct.unpack_from("<QQ", index)
        at = struct.calcsize("<QQ")
        self._ids = _unpacked(index[at : at + n])
        self.bounds = EliasFano.frombytes(index[at + n :])

    def doc_ids(self, a: int, b: int) -> pa.Array:
        """The doc_ids of documents a to b - 1."""
        out, at = [pa.nulls(max(0, min(b, self.nulls) - a), pa.int64())], self.nulls
        for first, distances in self._ids:
            out.append(pa.array(distances.range(max(0, a - at), min(distances.n, b - at)) + first))
            at += distances.n
        return pa.concat_arrays(out)

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1 of the file."""
        data = self.file.read_at((b - a) * self.width, len(MAGIC) + a * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.read(self.bounds.select(i), self.bounds.select(i + 1))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            f, group = TokenFile(path), 1 << 14
            block, at = np.zeros(0, "<u4"), 0  # ids from position at on
            for d in range(0, f.documents, group):
                n = min(group, f.documents - d)
                bounds = f.bounds.range(d, d + n + 1)
                crcs = np.zeros(n, np.int64)
                for i in range(n):
                    a, b, crc = int(bounds[i]), int(bounds[i + 1]), 0
                    while a < b:
                        if not at <= a < at + len(block):
                            block, at = f.read(a, min(f.ids, a + BLOCK // f.width)).astype("<u4"), a
                        piece = block[a - at : b - at]
                        crc, a = zlib.crc32(piece, crc), a + len(piece)
                    crcs[i] = crc
                yield pa.RecordBatch.from_arrays([f.doc_ids(d, d + n), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crcs)], schema=_arrow(ROWS))


def write_token_files(documents: DataFrame, folder: str, vocabulary: str, end_id: int) -> list[tuple]:
    """Encodes documents(doc_id, text) into files of the folder, in ascending doc_id order; returns (path, ids before it)."""
    spark = documents.sparkSession
    common.arrow_limits(spark)
    ordered = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    manifest = common.written(ordered.mapInArrow(lambda it: _write(it, folder, vocabulary, end_id), MANIFEST), "token-manifest")
    files = sorted(manifest.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_hash))  # one row for each file
    common.forget(manifest)
    bases = np.concatenate([[0], np.cumsum([r.ids for r in files], dtype=np.int64)])
    return [(r.path, int(b)) for r, b in zip(files, bases, strict=False)]


def read_token_files(spark, files: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    return common.one_task_each(spark, files, "path string, base long", "base").mapInArrow(_read, ROWS)
