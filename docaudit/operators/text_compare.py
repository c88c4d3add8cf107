"""Text comparison of the documents of a batch, all pairs of all batches in one job.

Recall, IDF, cosine, containment and the sequence ratio of a pair of documents need both documents' paragraphs together, a
group that is bounded by the documents of a batch; an Arrow function computes them on arrays, a batch at a time from rows in
order of batches. What follows (top matches, findings, rates, sections) is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TextCompare
from ..functions.text import comparable, once, stable_id, rounded
from .interference import action, category

SCORES = "batch long, left_doc long, right_doc long, left_ord int, right_ord int, shared int, candidate_rank int, jaccard double, tfidf_cosine double, containment double, sequence_ratio double, raw_score double, factor double, score double"


#: What the comparison and its findings read of a paragraph.
COMPARED = ("batch", "doc_id", "ord", "normalized", "weight", "sha256", "document_id", "paragraph_id", "char_count", "section")


def prepared(paragraphs: DataFrame, settings: TextCompare = TextCompare(), **interference) -> DataFrame:
    """Paragraphs that take part, in their compared form, with their weight."""
    what = category(F.col("text"), F.col("heading_level"), **interference)
    form = once(paragraphs.where("heading_level IS NULL"), normalized=comparable(F.col("text")), _category=what).withColumn("_action", F.coalesce(action(F.col("_category")), F.lit("")))
    kept = form.where((F.col("_action") != "exclude") & (F.length("normalized") >= settings.min_chars))
    return kept.withColumn("normalized", F.substring("normalized", 1, settings.max_chars)).withColumn("weight", F.when(F.col("_action") == "downweight", settings.downweight).otherwise(1.0)).withColumn("char_count", F.length("normalized")).drop("_category", "_action")


def _numbered(keys: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Dense numbers of keys below most, in their order, and how many there are."""
    if most <= max(1 << 16, 64 * len(keys)):
        seen = np.zeros(most, np.int64)
        seen[keys] = 1
        total = seen.cumsum()
        return total[keys] - 1, int(total[-1]) if most else 0
    kept, out = np.unique(keys, return_inverse=True)
    return out, len(kept)


class _Grams:
    """The n-grams of a batch's paragraphs, by gram and paragraph, each pair once with its count."""

    def __init__(self, texts: list[str], doc: np.ndarray, sizes: set[int]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner, left = np.repeat(np.arange(len(texts)), lengths), np.repeat(lengths.cumsum(), lengths) - np.arange(len(chars))
        chars, alphabet = _numbered(chars, int(chars.max(initial=0)) + 1)
        gram, paragraph, count, self.first, ids, known, base = [], [], [], {}, chars, alphabet, 0
        for n in range(1, max(sizes) + 1):
            if n > 1:
                kept = left[: len(ids) - 1] >= n if len(ids) else np.zeros(0, bool)
                # places without n characters left get a number too, which no one reads
                ids, known = _numbered(np.where(kept, ids[:-1] * alphabet + chars[n - 1 :], 0), known * alphabet) if len(ids) > 1 else (ids[:0], 0)
            if n in sizes:
                whole = left[: len(ids)] >= n
                pairs, c = np.unique(ids[whole] * len(texts) + owner[: len(ids)][whole], return_counts=True)
                gram.append(pairs // len(texts) + base)
                paragraph.append(pairs % len(texts))
                count.append(c)
                self.first[n] = (base, base + known)
                base += known
        self.gram, self.paragraph, self.count = np.concatenate(gram), np.concatenate(paragraph), np.concatenate(count).astype(np.float64)
        docs = int(doc[-1]) + 1
        of = doc[self.paragraph]
        #: paragraphs of each document that have a gram
        self.frequency = np.bincount(of * base + self.gram, minlength=docs * base).reshape(docs, base)
        #: each document's entries, by gram
        self.entries = [(self.gram[at], self.paragraph[at], self.count[at]) for at in (np.flatnonzero(of == d) for d in range(docs))]
        self.n = {n: np.bincount(self.paragraph[slice(*self.gram.searchsorted(span))], minlength=len(texts)) for n, span in self.first.items()}


#: Numbers of one dense block of a pair of documents.
_DENSE = 1 << 21


def _pair(g: _Grams, a: int, b: int, bounds: np.ndarray, s: TextCompare) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared recall grams, shared trigrams and cosines of all paragraphs of two documents."""
    (a0, a1), (b0, b1) = bounds[a : a + 2], bounds[b : b + 2]
    total = a1 - a0 + b1 - b0
    idf = (np.log((1 + total) / (1 + np.arange(total + 1.0))) + 1.0)[g.frequency[a] + g.frequency[b]]
    weighed = slice(g.first[s.ngram_min][0], g.first[s.ngram_max][1])
    outside = np.ones(len(idf), bool)
    outside[weighed] = False
    idf[outside] = 0.0  # grams of a length that only recall or containment read
    both = np.flatnonzero((g.frequency[a] > 0) & (g.frequency[b] > 0))
    column = np.full(len(idf), -1)
    column[both] = np.arange(len(both))
    sides, norms = [], []
    for d, start, stop in ((a, a0, a1), (b, b0, b1)):
        gram, paragraph, count = g.entries[d]
        paragraph = paragraph - start
        norms.append(np.sqrt(np.bincount(paragraph, np.square(count * idf[gram]), minlength=stop - start)))
        at = column[gram]
        there = np.flatnonzero(at >= 0)
        sides.append((at[there], paragraph[there], count[there]))
    shape = (a1 - a0, b1 - b0)
    dot, shared, three = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    weight = idf[both] ** 2
    step = max(256, _DENSE // max(shape))
    spans = [(out, *both.searchsorted(g.first[n]).tolist()) for out, n in ((shared, s.recall_ngram), (three, 3))]
    for lo in range(0, len(both), step):
        hi = min(len(both), lo + step)
        x, y = (np.zeros((rows, hi - lo)) for rows in shape)
        for dense, (at, paragraph, count) in zip((x, y), sides, strict=True):
            part = slice(*at.searchsorted((lo, hi))) if hi - lo < len(both) else slice(None)
            dense[paragraph[part], at[part] - lo] = count[part]
        for out, p, q in spans:
            p, q = max(p - lo, 0), min(q, hi) - lo
            if p < q:
                out += (x[:, p:q] > 0).astype(np.float32) @ (y[:, p:q] > 0).astype(np.float32).T
        dot += (x * weight[lo:hi]) @ y.T
    lengths = norms[0][:, None] * norms[1]
    return shared, three, np.minimum(1.0, dot / np.where(lengths > 0, lengths, 1.0))


def _ratio(a: str, b: str) -> float:
    """SequenceMatcher's ratio; copies are one block, which needs no search."""
    return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()


#: Places where two texts agree that are held at once; if one rectangle has more, SequenceMatcher itself takes it.
_POINTS = 1 << 20
#: Characters of the pairs of texts that are matched at once.
_CHARS = 1 << 17
#: Agreement of so many characters is looked for first, then that of single ones in the small rectangles between.
_LONG = 4


def _places(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges, one after the other, and the range of each."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (lo - n.cumsum() + n)[of], of


class _Blocks:
    """Characters in the blocks that SequenceMatcher finds in pairs of texts, for all pairs at once.

    A rectangle is a part of either text of a pair. Its longest run of agreeing characters (of these the first in the left text,
    then in the right one) is a block, and what lies before and behind it in both texts are two rectangles more.
    """

    def __init__(self, texts: list[str], left: np.ndarray, right: np.ndarray, need: np.ndarray):
        """need: a pair that cannot have so many characters in blocks is left, with what it has."""
        self.texts, self.left, self.right, self.need = texts, left, right, need
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base, self.wide = self.lengths.cumsum() - self.lengths, int(self.lengths.max(initial=0)) + 1
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.ids = {1: _numbered(chars, int(chars.max(initial=0)) + 1)}
        ids, known = self.ids[1]
        for n in range(2, _LONG + 1):
            # grams that reach into the next text are never read
            ids, known = _numbered(ids[:-1] * self.ids[1][1] + self.ids[1][0][n - 1 :], known * self.ids[1][1])
        self.ids[_LONG] = ids, known
        a, b = self.lengths[left], self.lengths[right]
        self.matched, self.most = np.zeros(len(left), np.int64), np.minimum(a, b)
        whole = np.stack([np.arange(len(left)), np.zeros_like(a), a, np.zeros_like(b), b])
        part = (a + b).cumsum() // _CHARS
        for at in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            self._divide(self._divide(whole[:, at], _LONG), 1)

    def _divide(self, rects: np.ndarray, k: int) -> np.ndarray:
        """Takes blocks of k characters or more out of rectangles; returns the rectangles that remain, without such a block."""
        rects = rects[:, (rects[1] < rects[2]) & (rects[3] < rects[4]) & (self.most[rects[0]] >= self.need[rects[0]])]
        if not rects.shape[1]:
            return rects
        runs = self._runs(rects, k)
        if runs is None and rects.shape[1] > 1:
            return np.concatenate([self._divide(half, k) for half in np.array_split(rects, 2, axis=1)], axis=1)
        if runs is None:
            pair, alo, ahi, blo, bhi = rects[:, 0]
            a, b = self.texts[self.left[pair]][alo:ahi], self.texts[self.right[pair]][blo:bhi]
            self.matched[pair] += round(_ratio(a, b) * (len(a) + len(b)) / 2)
            return rects[:, :0]
        r, i, j, n = runs
        rest, wide = [], self.wide
        while True:
            there = np.bincount(r, minlength=rects.shape[1]) > 0
            rest.append(rects[:, ~there])
            if not len(r):
                return np.concatenate(rest, axis=1)
            rects, r = rects[:, there], (there.cumsum() - 1)[r]
            pair, alo, ahi, blo, bhi = rects
            best = np.maximum.reduceat((n * wide + wide - 1 - i) * wide + wide - 1 - j, r.searchsorted(np.arange(len(pair))))
            size, x, y = best // wide**2, wide - 1 - best // wide % wide, wide - 1 - best % wide
            self.matched += np.bincount(pair, size, len(self.matched)).astype(np.int64)
            less = np.minimum(ahi - alo, bhi - blo) - np.minimum(x - alo, y - blo) - np.minimum(ahi - x, bhi - y)
            self.most -= np.bincount(pair, less, len(self.most)).astype(np.int64)
            before = np.minimum(n, np.minimum(x[r] - i, y[r] - j))
            cut = np.maximum(0, np.maximum((x + size)[r] - i, (y + size)[r] - j))
            open_ = (self.most >= self.need)[pair][r]
            p, q = np.flatnonzero(open_ & (before >= k)), np.flatnonzero(open_ & (n - cut >= k))
            rects = np.stack([np.stack([pair, pair]), np.stack([alo, x + size]), np.stack([x, ahi]), np.stack([blo, y + size]), np.stack([y, bhi])]).transpose(0, 2, 1).reshape(5, -1)
            r, i, j, n = np.concatenate([2 * r[p], 2 * r[q] + 1]), np.concatenate([i[p], (i + cut)[q]]), np.concatenate([j[p], (j + cut)[q]]), np.concatenate([before[p], (n - cut)[q]])
            order = np.argsort(r, kind="stable")
            r, i, j, n = r[order], i[order], j[order], n[order]

    def _runs(self, rects: np.ndarray, k: int) -> tuple[np.ndarray, ...] | None:
        """Longest runs of k agreeing characters or more: rectangle, place in either text, length. None if there are too many places."""
        (pair, alo, ahi, blo, bhi), (ids, known) = rects, self.ids[k]
        i, of = _places(alo, np.maximum(alo, ahi - k + 1))
        # many pairs have the same right text: its places are put in order once
        right = self.right[pair]
        _, one, part = np.unique((right * self.wide + blo) * self.wide + bhi, return_index=True, return_inverse=True)
        j, to = _places(blo[one], np.maximum(blo[one], (bhi - k + 1)[one]))
        keys, sought = to * known + ids[j + self.base[right[one]][to]], part[of] * known + ids[i + self.base[self.left[pair]][of]]
        j = j[np.argsort(keys)]
        if len(one) * known <= 32 * len(sought):
            count = np.bincount(keys, minlength=len(one) * known)
            first, n = (count.cumsum() - count)[sought], count[sought]
        else:
            keys.sort()
            first = keys.searchsorted(sought)
            n = keys.searchsorted(sought, "right") - first
        if k == 1:
            # a block's characters are found in both texts
            short = np.minimum(ahi - alo, bhi - blo)
            over = np.maximum(0, short - np.bincount(of[n > 0], minlength=len(pair)))
            self.most[self.most - np.bincount(pair, over, len(self.most)) < self.need] = -1
            n = np.where((self.most >= self.need)[pair][of], n, 0)
        if n.sum() > _POINTS:
            return None
        at, who = _places(first, first + n)
        # along the diagonals of each rectangle
        line = np.sort(((of[who] * 2 * self.wide) + self.wide + j[at] - i[who]) * self.wide + i[who])
        begin = np.flatnonzero(np.diff(line, prepend=-2) != 1)
        n, line = np.diff(begin, append=len(line)) + k - 1, line[begin]
        i, line = line % self.wide, line // self.wide
        return line // (2 * self.wide), i, line % (2 * self.wide) - self.wide + i, n


def _ratios(texts: list[str], left: np.ndarray, right: np.ndarray, need: np.ndarray) -> np.ndarray:
    """SequenceMatcher's ratio of pairs of texts; 0 for those that cannot reach need."""
    out = np.fromiter((texts[i] == texts[j] for i, j in zip(left.tolist(), right.tolist(), strict=True)), np.float64, len(left))
    if len(at := np.flatnonzero(out == 0)):
        kept, numbers = np.unique(np.concatenate([left[at], right[at]]), return_inverse=True)
        texts, (i, j) = [texts[k] for k in kept.tolist()], numbers.reshape(2, -1)
        total = np.fromiter(map(len, texts), np.int64, len(texts))
        total = total[i] + total[j]
        found = _Blocks(texts, i, j, need[at] * total / 2)
        out[at] = np.where(found.most >= found.need, 2.0 * found.matched / np.maximum(total, 1), 0.0)
    return out


def _compare(batch: int, doc_ids: np.ndarray, ords: np.ndarray, texts: list[str], weights: np.ndarray, s: TextCompare, sequence: bool, least: float | None = None) -> list[np.ndarray]:
    """Columns of SCORES of one batch, whose paragraphs come by doc_id and ord. Below a score of least a sequence ratio may be left out (0)."""
    kept, doc = np.unique(doc_ids, return_inverse=True)
    if len(kept) > s.max_documents:
        raise ValueError(f"a batch has at most {s.max_documents} documents")
    out = []
    if len(kept) > 1:
        g = _Grams(texts, doc, {s.recall_ngram, 3, *range(s.ngram_min, s.ngram_max + 1)})
        bounds = np.searchsorted(doc, np.arange(len(kept) + 1))
        recall, trigrams = g.n[s.recall_ngram], g.n[3]
        for a, b in combinations(range(len(kept)), 2):
            shared, three, cosines = _pair(g, a, b, bounds, s)
            x, y = np.nonzero(shared >= s.min_shared) if s.min_shared > 0 else np.nonzero(np.ones(shared.shape, bool))
            i, j, both = x + bounds[a], y + bounds[b], shared[x, y]
            jaccard = both / np.maximum(recall[i] + recall[j] - both, 1)
            order = np.lexsort((y, -jaccard, x))
            rank = np.arange(len(x)) - np.searchsorted(x, x) + 1
            order, rank = order[rank <= s.max_candidates], rank[rank <= s.max_candidates]
            x, y, i, j, both, jaccard = (v[order] for v in (x, y, i, j, both, jaccard))
            cosine = cosines[x, y]
            fewer = np.minimum(trigrams[i], trigrams[j])
            containment = np.where(fewer > 0, three[x, y] / np.maximum(fewer, 1), 0.0)
            ids = [np.full(len(x), v) for v in (batch, kept[a], kept[b])]
            out.append([*ids, ords[i], ords[j], both, rank, jaccard, cosine, containment, i, j])
    if not out:
        return []
    *columns, cosine, containment, i, j = (np.concatenate(c) for c in zip(*out, strict=True))
    lexical, factor, ratio = np.maximum(cosine, containment), np.minimum(weights[i], weights[j]), np.zeros(len(i))
    if sequence:
        at = np.flatnonzero(lexical >= s.sequence_gate)
        # scores are rounded at six places
        need = np.zeros(len(at)) if least is None else np.where((lexical * factor)[at] >= least, 0.0, (least - 1e-6) / factor[at])
        ratio[at] = _ratios(texts, i[at], j[at], need)
    raw = np.maximum(np.maximum(cosine, ratio), containment)
    return [*columns, cosine, containment, ratio, raw, factor, raw * factor]


def _by_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each batch of documents, of rows that come by batch."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        keys = part.column("batch").to_numpy()
        at = 0
        for cut in [*(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]:
            if cut == at:
                continue
            if held and held[0].column("batch")[0].as_py() != keys[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part.slice(at, cut - at))
            at = cut
    if held:
        yield pa.Table.from_batches(held)


def scores(prepared_paragraphs: DataFrame, settings: TextCompare = TextCompare(), sequence: bool = True, least: float | None = None) -> DataFrame:
    """Scores of all recalled candidates, or of those of a score of least or more. sequence=False leaves the sequence ratio out (0)."""
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[k]) for n, k in (x.split() for x in SCORES.split(", "))])

    def rounded_at(columns: list[np.ndarray]) -> list[np.ndarray]:
        # six places, half to even
        columns = [np.rint(c * 1e6) / 1e6 if f.type == pa.float64() else c.astype(f.type.to_pandas_dtype()) for c, f in zip(columns, schema, strict=True)]
        return columns if least is None else [c[at] for at in [columns[-1] >= least] for c in columns]

    def joined(found: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=schema)

    def run(parts):
        found, rows = [], 0
        for group in _by_batch(parts):
            ids, ords, weights = (group.column(c).to_numpy() for c in ("doc_id", "ord", "weight"))
            if columns := _compare(group.column("batch")[0].as_py(), ids, ords, group.column("normalized").to_pylist(), weights, settings, sequence, least):
                found.append(rounded_at(columns))
                rows += len(found[-1][0])
            if rows > 1 << 15:
                yield joined(found)
                found, rows = [], 0
        if found:
            yield joined(found)

    # batches are few bytes and much work: a fixed number of partitions keeps them from being joined into one task
    n = int(prepared_paragraphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prepared_paragraphs.select("batch", "doc_id", "ord", "normalized", "weight").where("batch IS NOT NULL AND doc_id IS NOT NULL")
    return rows.repartition(n, "batch").sortWithinPartitions("batch", "doc_id", "ord").mapInArrow(run, SCORES)


def findings(scored: DataFrame, prepared_paragraphs: DataFrame, settings: TextCompare = TextCompare()) -> DataFrame:
    """The top matches of each left paragraph at or above the medium score, with stable ids and ranks."""
    best = Window.partitionBy("batch", "left_doc", "right_doc", "left_ord").orderBy(F.desc("score"), "right_ord")
    top = scored.where(F.col("score") >= settings.medium).withColumn("match_rank", F.row_number().over(best)).where(F.col("match_rank") <= settings.top_matches)
    sides = [prepared_paragraphs.select(F.col("doc_id").alias(f"{s}_doc"), F.col("ord").alias(f"{s}_ord"), F.col("sha256").alias(f"{s}_sha"), F.col("document_id").alias(f"{s}_document_id"), F.col("paragraph_id").alias(f"{s}_paragraph_id"), F.col("char_count").alias(f"{s}_chars"), F.col("section").alias(f"{s}_section")) for s in ("left", "right")]
    joined = top.join(sides[0], ["left_doc", "left_ord"]).join(sides[1], ["right_doc", "right_ord"])
    order = Window.partitionBy("batch", "left_doc", "right_doc").orderBy(F.desc("score"), "left_ord", "right_ord")
    return joined.withColumn("finding_id", stable_id("txt-", *[F.col(c) for c in ("left_sha", "left_paragraph_id", "right_sha", "right_paragraph_id")])).withColumn("severity", F.when(F.col("score") >= settings.high, "high").otherwise("medium")).withColumn("rank", F.row_number().over(order)).drop("left_sha", "right_sha")


def pair_summary(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """High and medium findings and the greatest similarity of every pair(batch, left_doc, right_doc), also those without findings."""
    keys = ["batch", "left_doc", "right_doc"]
    counts = found.groupBy(keys).agg(F.count_if(F.col("severity") == "high").alias("high_count"), F.count_if(F.col("severity") == "medium").alias("medium_count"), F.max("score").alias("max_similarity"))
    return pairs.join(counts, keys, "left").select(*keys, F.coalesce("high_count", F.lit(0)).cast("long").alias("high_count"), F.coalesce("medium_count", F.lit(0)).cast("long").alias("medium_count"), F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"))


def document_pairs(prepared_paragraphs: DataFrame, docs: DataFrame) -> DataFrame:
    """All pairs of documents of a batch, in order."""
    a, b = (docs.select("batch", F.col("doc_id").alias(f"{s}_doc")) for s in ("left", "right"))
    return a.join(b, "batch").where("left_doc < right_doc")


def document_stats(found: DataFrame, prepared_paragraphs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair and side: eligible and repeated paragraphs and characters, and the repeated rate (high findings alone)."""
    keys = ["batch", "left_doc", "right_doc"]
    totals = prepared_paragraphs.groupBy("doc_id").agg(F.count("*").alias("eligible_paragraphs"), F.sum("char_count").alias("eligible_chars"))
    out = None
    for side in ("left", "right"):
        repeated = found.where("severity = 'high'").select(*keys, F.col(f"{side}_ord").alias("ord"), F.col(f"{side}_chars").alias("chars")).distinct().groupBy(keys).agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
        part = pairs.withColumn("side", F.lit(side)).withColumn("doc_id", F.col(f"{side}_doc")).join(repeated, keys, "left").join(totals, "doc_id", "left")
        out = part if out is None else out.unionByName(part)
    zero = F.lit(0).cast("long")
    out = out.select(*keys, "side", "doc_id", F.coalesce("eligible_paragraphs", zero).alias("eligible_paragraphs"), F.coalesce("eligible_chars", zero).alias("eligible_chars"), F.coalesce("n", zero).alias("repeated_paragraphs"), F.coalesce("c", zero).alias("repeated_chars"))
    return out.withColumn("repeated_rate", F.when(F.col("eligible_chars") > 0, rounded(F.col("repeated_chars") / F.col("eligible_chars"), 6)).otherwise(0.0))


def top_sections(found: DataFrame, limit: int = 10) -> DataFrame:
    """The pairs of sections with the most high findings, per pair of documents."""
    keys = ["batch", "left_doc", "right_doc"]
    grouped = found.groupBy(*keys, F.col("left_section").alias("source_section"), F.col("right_section").alias("peer_section")).agg(F.count("*").alias("pair_count"), F.count_if(F.col("severity") == "high").alias("high_pair_count"), F.max("score").alias("max_similarity"))
    order = Window.partitionBy(*keys).orderBy(F.desc("high_pair_count"), F.desc("max_similarity"), F.desc("pair_count"), "source_section", "peer_section")
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
