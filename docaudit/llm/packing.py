"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut: whole windows go out as they are, what remains is cut into parts of a quarter window at most.
Parts gather until they fill some 128 windows less a few ids; differencing then merges partial partitions, the largest
sums of one with the smallest of the other, and gives windows of nearly equal length. If one exceeds the capacity, the
window count rises by one and it begins again. A task packs what it reads, so nothing is shuffled; the numbers of its
sequences begin with its partition's.

Defined results: null text is empty and has its end id alone; each row is a document of its own, equal rows and rows with
one doc_id too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Windows that one differencing fills, ids left free in each on average, and parts that a window's worth is cut into.
WINDOWS, SLACK, PARTS = 128, 3, 4


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k sets of nearly equal sums (largest differencing, k-way)."""
    n, heap, made = len(sizes), [], []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]  # the largest of one meets the smallest of the other
        order = sums.argsort(kind="stable")
        sums = sums[order]
        sums -= sums[0]  # a common part does not count
        heapq.heappush(heap, (-int(sums[-1]), n + len(made), sums))
        made.append((a, b, order))
    sets: list[list[int]] = [[] for _ in range(k if n else 0)]
    # downwards: the set in which each place of a partial partition ends up; an item's place is the last
    places = {n + len(made) - 1: np.arange(k)} if n else {}
    for at in range(n + len(made) - 1, -1, -1):
        place = places.pop(at)
        if at < n:
            sets[place[-1]].append(at)
            continue
        a, b, order = made[at - n]
        places[a], places[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        places[a][order] = place
        places[b][k - 1 - order] = place
    return sets


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets of indices, each of capacity at most; the count rises until every set fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = difference(sizes, k)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return [s for s in sets if s]
        k += 1


class Packer:
    """Takes (doc_id, ids) and gives rows of PIECES."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.aim = WINDOWS * (capacity - SLACK)
        self.parts: list[tuple] = []
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self._row(doc_id, at, ids[at : at + self.capacity], n, self.sequence, 0)
            self.sequence += 1
            at += self.capacity
        step = max(1, self.capacity // PARTS)
        while at < n:
            size = min(step, n - at, self.aim - self.held)
            self.parts.append((doc_id, at, ids[at : at + size], n))
            self.held += size
            at += size
            if self.held >= self.aim:
                self.flush()

    def _row(self, doc_id, start, ids, n, sequence, offset) -> None:
        self.rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), n, sequence, offset))

    def flush(self) -> None:
        for members in pack([len(p[2]) for p in self.parts], self.capacity):
            offset = 0
            for i in sorted(members):
                doc_id, start, ids, n = self.parts[i]
                self._row(doc_id, start, ids, n, self.sequence, offset)
                offset += len(ids)
            self.sequence += 1
        self.parts, self.held = [], 0

    def take(self, least: int = 0) -> pa.RecordBatch | None:
        if len(self.rows) <= least:
            return None
        columns = list(zip(*self.rows, strict=True))
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])


def _pack_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    memo, packer = tokens.memo(vocabulary), Packer(capacity, common.task_number() << 40)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            packer.add(doc_id, np.frombuffer(memo.ids(text) + end, "<u4"))
            if out := packer.take(4000):
                yield out
    packer.flush()
    if out := packer.take():
        yield out


def pack_documents(documents: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """The pieces of documents(doc_id, text) and where they lie."""
    common.arrow_limits(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _pack_batches(it, vocabulary, end_id, capacity), PIECES)
