"""Quality classifier: logistic regression on hashed word n-grams, trained by follow the regularised leader.

The words of a text (and its words' shapes: letters, capitals, digits, the marks at both ends) give 1- and 2-grams, hashed
into BUCKETS weights. A text's value for a gram is its share of the grams, so a score is one sparse dot product. Training
takes a sample of at most about `bound` labelled rows, chosen by a hash of doc_id, in one task; scoring is a map over all.

Defined results: null text counts as empty and scores by the intercept alone; a doc_id labelled more than once has the
mean of its labels; labels without doc_id or quality are left out; without labels every score is 0.5; rows with one
doc_id each have a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_store import _arrow

BUCKETS = 1 << 18
#: Labelled rows to train on, about.
BOUND = 8_000
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.3, 0.1, 0.002, 0.02
#: What a gram's share is multiplied by.
SCALE = 10.0
WEIGHTS = "bucket long, weight double"
SCORES = "doc_id long, score double"
#: The last bucket holds the intercept.
_BIAS = BUCKETS - 1

_CLASS = np.full(256, 1, np.uint64)
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = np.arange(4, 36)
_KINDS = [np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(1, 6)]


def grams(words: np.ndarray, data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Buckets of all grams of a text's words."""
    start, end = spans[:, 0], spans[:, 1]
    last = end - 1
    with np.errstate(over="ignore"):
        shape = _CLASS[data[start]]
        for at in (np.minimum(start + 1, last), np.maximum(last - 1, start), last):
            shape = shape * np.uint64(64) + _CLASS[data[at]]
        again = words[1:] == words[:-1]
        pair = words[:-1] * np.uint64(0xD6E8FEB86659FD93) ^ words[1:]
        views = [words ^ _KINDS[0], pair ^ _KINDS[1], common.mixed(shape ^ _KINDS[2]), common.mixed((shape[:-1] * np.uint64(1 << 24) + shape[1:]) ^ _KINDS[3]), np.full(int(again.sum()), _KINDS[4])]
        return (common.mixed(np.concatenate(views)) % np.uint64(BUCKETS - 1)).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(index, words, buckets of grams) of each text that has words."""
    data, ends = common.text_parts(column)
    for i, words, spans in common.words_by_text(column):
        yield i, len(words), grams(words, data[ends[i] :], spans)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights from (buckets, values, label) by FTRL-proximal with a rate per weight."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            i, x, y = rows[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(BUCKETS))


def sparse(buckets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    i, counts = np.unique(buckets, return_counts=True)
    return np.append(i, _BIAS).astype(np.int32), np.append(counts * (SCALE / words), 1.0)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        labels, empty = batch.column("label").to_numpy(), set(range(batch.num_rows))
        for i, words, buckets in _texts(batch.column("text")):
            rows.append((*sparse(buckets, words), float(labels[i])))
            empty.discard(i)
        rows += [(np.array([_BIAS]), np.ones(1), float(labels[i])) for i in sorted(empty)]
    weights = train(rows) if rows else np.zeros(BUCKETS)
    used = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(weights[used])], schema=_arrow(WEIGHTS))


def fit(documents: DataFrame, labels: DataFrame, bound: int = BOUND, folds: int = 5) -> np.ndarray:
    """Weights learned from labelled rows outside fold 0 of crc32(doc_id)."""
    common.arrow_limits(documents.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label")).where(common.crc_of(F.col("doc_id")) % folds != 0)
    share = min(1.0, bound / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the sample's ids are bounded by a parameter, so they may be broadcast; the texts stay where they are
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = rows.select(F.xxhash64("doc_id").alias("key"), "label", "text").repartition(1).sortWithinPartitions("key", "text")
    weights = np.zeros(BUCKETS)
    for r in rows.mapInArrow(_train, WEIGHTS).collect():  # at most BUCKETS rows
        weights[r.bucket] = r.weight
    return weights


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of documents(doc_id, text)."""
    common.arrow_limits(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # BUCKETS doubles, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, w[_BIAS])
            for i, words, buckets in _texts(batch.column("text")):
                out[i] += w[buckets].sum() * (SCALE / words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], schema=_arrow(SCORES))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def held_out(doc_id, folds: int = 5) -> F.Column:
    return common.crc_of(doc_id) % folds == 0

