"""Pieces that several operators share: scratch tables, Arrow batches and vectorised word hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; its temporaries take about twelve times as much.
PIECE = 1 << 20
#: Bytes of an Arrow batch sent to a Python worker, so that long rows do not add up.
BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, set here only if unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = sc._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docaudit-")
        sc.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/docaudit-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, what)
    writer = df.write.option("compression", "zstd")
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docaudit_path = path  # for forget()
    released(df.sparkSession)
    return out


def released(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that are done once the driver has collected them as garbage."""
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        gc.collect()
        spark._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(df, "_docaudit_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def arrow_limits(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, which Spark bounds by rows alone, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(key)))) > 16 << 20:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    column = column.fill_null("")
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        out = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return out[0], out[1]


#: For plain words: all but letters, digits and bytes beyond ASCII separate.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _piece_words(data: np.ndarray, cuts: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one piece; cuts are positions where a text begins."""
    n = len(data)
    solid = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    size = 1 << max(12, int(n).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_CODE[_LOWER[data]] * power[:n], out=total[1:])
        hashes = mixed((total[ends] - total[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))
    return starts, ends, hashes


def word_pieces(data: np.ndarray, ends: np.ndarray, space: np.ndarray = _SPACE) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, offset, text index, starts, ends, hashes of words) for pieces of about PIECE bytes.

    A word is a maximal run of bytes that are not in space (0x20 and 0x09-0x0D if not given), A-Z lower-cased. A text longer than a piece
    continues in the next one; pieces of one text are cut at white space.
    """
    n, at, text = len(ends) - 1, 0, 0
    total = int(ends[-1])
    while text < n and at <= total:
        stop = min(total, at + PIECE)
        if stop < total:
            last = int(np.searchsorted(ends, stop, "right")) - 1  # the text that holds the byte at stop
            if ends[last] > at:
                stop = int(ends[last])
            else:
                spaces = np.flatnonzero(space[data[at:stop]])
                if len(spaces):
                    stop = at + int(spaces[-1]) + 1
                else:
                    rest = np.flatnonzero(space[data[stop : int(ends[last + 1])]])
                    stop = stop + int(rest[0]) + 1 if len(rest) else int(ends[last + 1])
        first = int(np.searchsorted(ends, at, "right")) - 1
        if stop >= total:
            upto = n
        else:
            upto = int(np.searchsorted(ends, stop, "left"))
            upto = max(upto, first + 1)
        if stop > at:
            cuts = ends[first : upto + 1]
            cuts = cuts[(cuts > at) & (cuts < stop)] - at
            s, e, h = _piece_words(data[at:stop], np.unique(np.append(cuts, 0)), space)
            owner = np.searchsorted(ends, s + at, "right") - 1
            yield first, upto, at, owner, s + at, e + at, h
        if stop >= total:
            return
        at = stop
        text = first if at < ends[first + 1] else upto


def words_by_text(column: pa.Array, space: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, word hashes, word starts and ends) of each text that has a word."""
    data, ends = text_parts(column)
    open_text, parts = -1, []
    for _, _, _, owner, s, e, h in word_pieces(data, ends, space):
        if not len(owner):
            continue
        where = np.flatnonzero(np.diff(owner)) + 1
        for a, b in zip(np.append(0, where), np.append(where, len(owner)), strict=True):
            if (i := int(owner[a])) != open_text:
                if parts:
                    yield open_text, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                open_text, parts = i, []
            base = ends[i]
            parts.append((h[a:b], np.stack([s[a:b] - base, e[a:b] - base], 1)))
    if parts:
        yield open_text, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, k)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, np.uint64(size), np.uint64)
        for j in range(size):
            out = (out * np.uint64(0xD6E8FEB86659FD93)) ^ words[j : n - size + 1 + j]
            out = out * np.uint64(0xA0761D6478BD642F) + (out >> np.uint64(29))
    return np.unique(mixed(out))


def crc_of(column) -> F.Column:
    """Unsigned crc32 of a value's text."""
    return F.crc32(column.cast("string").cast("binary"))


def storage(uri: str):
    """The Arrow filesystem and the path in it of a folder or file that all executors reach."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class SharedFile:
    """Writes a file under a passing name and moves it into place when complete, so that a repeated task replaces it whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = storage(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.passing = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.uri = f"{folder.rstrip('/')}/{name}"
        self.size = 0
        self._out = self.fs.open_output_stream(self.passing, compression=None, buffer_size=1 << 20)

    def write(self, data) -> int:
        """Returns the offset at which data begins."""
        at = self.size
        self._out.write(data)
        self.size += memoryview(data).nbytes
        return at

    def close(self) -> None:
        self._out.close()
        self.fs.move(self.passing, self.final)


def task_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def one_task_each(spark: SparkSession, rows: list[tuple], schema: str, key: str) -> DataFrame:
    """A manifest of files, one partition for each."""
    df = spark.createDataFrame(rows, schema)
    return df.repartitionByRange(max(1, len(rows)), key) if rows else df
