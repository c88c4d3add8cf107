"""N-gram Jaccard join by signature trees: exact links of documents, and their components.

1. A document's set of shingle hashes gives its size, a bitmap of BITS bits, a hash of the whole set (equal sets are one
   class) and its prefix: of two sets with the similarity, the prefixes have a token in common, in any one order of
   tokens. Tokens that a sample of documents shows to be frequent come last in that order, the most frequent ones at the
   end; it decides speed, not results.
2. Classes that share a prefix token are a bucket. Its leader is the class in whose prefix the token stands first: of a
   group of copies the one with the fewest tokens of its own. Each class is compared with the leader of most of its
   buckets; what passes the signature's bound is compared exactly, and near classes are joined into components.
3. A class reaches partners up to a size, as a near pair overlaps after its first common token: what stands before the
   token in either prefix bounds the overlap. Members that reach none of another component of their bucket, by the extremes
   of sizes and reaches, leave it; that is linear, and empties the bucket of copies that are near to the leader or to none.
4. Of buckets that still hold several components, a tree is built: nodes hold OR-combined bitmaps, size ranges, the tokens
   left after the bucket's and the one component below them, if it is one. Two nodes are taken further only while their
   largest possible overlap suffices and they may hold different components. Pairs left are compared exactly. Larger
   buckets are dealt out in pairs of blocks. No link between components is lost, so the components are exact.

Defined results: null text and a text without words have no shingles and no links (component_id is the own doc_id); rows
that share a doc_id count as one document in the links; a null doc_id stays alone and has a null component_id; repeated
rows each have a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import forget, written
from .components import components

SHINGLE, BITS = 5, 2048
#: 100 * shared >= LEAST * union.
LEAST = 75
#: Documents sampled for the order of tokens, occurrences from which a token is frequent, and how many such are kept.
SAMPLE, FREQUENT, KEPT = 32_768, 3, 1 << 20
#: Rows of a bucket that a task takes at once, classes in a leaf, and children of a node.
BLOCK, LEAF, FAN = 2048, 16, 8

SIGNATURES = "doc_id long, n_shingles long, class long, bits binary, prefix array<long>"
_SIGNATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _class_of(found: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        whole = np.array([common.mixed(found).sum() ^ np.uint64(len(found)) * np.uint64(0x9E3779B97F4A7C15)], np.uint64)
    return int(common.mixed(whole).view(np.int64)[0])


def _bitmap(found: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(found >> np.uint64(40)).astype(np.int64) % BITS] = 1
    return np.packbits(bits)


def _prefix(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first tokens of the set: one more than may be missing from a near set."""
    n, (tokens, levels) = len(found), frequent
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
        level = np.where(tokens[at] == found, levels[at], 0)
        if level.any():
            found = found[np.argsort(level, kind="stable")]
    return found[: n - -(-LEAST * n // 100) + 1]


def _token_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [f for _, w, _ in common.words_by_text(batch.column("text")) if len(f := common.shingles(w, SHINGLE))]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], names=["token"])


def frequent_tokens(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that are frequent in a bounded sample of documents, and their levels: twice the logarithm of their count."""
    share = min(1.0, SAMPLE / max(1, documents.count()))
    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else documents
    counts = sample.select("text").mapInArrow(_token_sample, "token long").groupBy("token").count().where(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "token").limit(KEPT).select("token", F.floor(2 * F.log2("count")).cast("byte").alias("level")).toArrow()
    tokens = rows.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column(1).to_numpy().astype(np.int8)[order]


def signatures(documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(frequent)  # KEPT numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            n = batch.num_rows
            sizes, classes, bits, prefixes = np.zeros(n, np.int64), [None] * n, [None] * n, [None] * n
            for i, words, _ in common.words_by_text(batch.column("text")):
                found = common.shingles(words, SHINGLE)
                sizes[i], classes[i], bits[i], prefixes[i] = len(found), _class_of(found), _bitmap(found).tobytes(), _prefix(found, late).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(classes, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], schema=_SIGNATURES)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNATURES)


# --- bounds and trees


def _ones(rows: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows).sum(-1, dtype=np.int64)


def _needed(a, b):
    """Least overlap of sets of sizes a and b with the similarity."""
    return -(-LEAST * (a + b) // (100 + LEAST))


def may_be_near(n_a: np.ndarray, bits_a: np.ndarray, n_b: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Whether the bound on the overlap suffices: shared bits, and the tokens that share a bit with others of their set."""
    slack = np.minimum(n_a - _ones(bits_a), n_b - _ones(bits_b))
    bound = np.minimum(_ones(bits_a & bits_b) + slack, np.minimum(n_a, n_b))
    return bound >= _needed(n_a, n_b)


class Level:
    """Nodes of one height: OR of bitmaps, size range, most slack, most tokens left, the one component below or several."""

    def __init__(self, bits, low, high, slack, rest, group, several):
        self.bits, self.low, self.high, self.slack, self.rest, self.group, self.several = bits, low, high, slack, rest, group, several

    def __len__(self):
        return len(self.low)

    def above(self, fan: int) -> Level:
        at = np.arange(0, len(self), fan)
        least, most = np.minimum.reduceat(self.group, at), np.maximum.reduceat(self.group, at)
        return Level(np.bitwise_or.reduceat(self.bits, at), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.slack, at), np.maximum.reduceat(self.rest, at), least, (least != most) | np.logical_or.reduceat(self.several, at))

    def may_link(self, i: np.ndarray, j: np.ndarray, other: Level) -> np.ndarray:
        apart = self.several[i] | other.several[j] | (self.group[i] != other.group[j])
        # sizes a <= b need 100 a >= LEAST b
        sized = (100 * self.high[i] >= LEAST * other.low[j]) & (100 * other.high[j] >= LEAST * self.low[i])
        keep = apart & sized & (np.minimum(self.rest[i], other.rest[j]) >= _needed(self.low[i], other.low[j]))
        at = np.flatnonzero(keep)
        bound = _ones(self.bits[i[at]] & other.bits[j[at]]) + np.minimum(self.slack[i[at]], other.slack[j[at]])
        keep[at] = bound >= _needed(self.low[i[at]], other.low[j[at]])
        return keep


class Tree:
    """Levels from single classes up to a root; classes are in the order of size and component."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rests: np.ndarray, groups: np.ndarray):
        self.order = np.lexsort((rests, groups, sizes))
        n, b, r, g = (x[self.order] for x in (sizes, bits, rests, groups))
        self.levels = [Level(b, n, n, n - _ones(b), r, g, np.zeros(len(n), bool))]
        self.fans = []
        while len(self.levels[-1]) > 1:
            fan = LEAF if len(self.levels) == 1 else FAN
            self.fans.append(fan)
            self.levels.append(self.levels[-1].above(fan))


def traverse(left: Tree, right: Tree, same: bool, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes (their indices) that may be near and are not in one component, by dual traversal from the roots."""
    stack = [(len(left.levels) - 1, len(right.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        x, y, i, j = stack.pop()
        keep = left.levels[x].may_link(i, j, right.levels[y])
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if x == 0 and y == 0:
            if same:
                i, j = i[i < j], j[i < j]
            yield left.order[i], right.order[j]
            continue
        down_left = x > 0 and x >= y
        down_right = y > 0 and y >= x
        if down_left:
            fan, size = left.fans[x - 1], len(left.levels[x - 1])
            i, j = (i[:, None] * fan + np.arange(fan)).ravel(), np.repeat(j, fan)
            i, j = i[i < size], j[i < size]
        if down_right:
            fan, size = right.fans[y - 1], len(right.levels[y - 1])
            j, i = (j[:, None] * fan + np.arange(fan)).ravel(), np.repeat(i, fan)
            i, j = i[j < size], j[j < size]
        x, y = x - down_left, y - down_right
        if same and x == y:
            i, j = i[i <= j], j[i <= j]
        for at in range(0, len(i), step):
            stack.append((x, y, i[at : at + step], j[at : at + step]))


def _tree_pairs(key, group):
    """Candidate pairs of one bucket, or of two blocks of it."""
    out = ([], [])
    columns = {c: group.column(c).combine_chunks() for c in ("class", "n_shingles", "rest", "bits", "component", "side")}
    classes, sizes, rests, groups, side = (columns[c].to_numpy() for c in ("class", "n_shingles", "rest", "component", "side"))
    bits = np.stack([np.frombuffer(x.as_buffer(), np.uint64) for x in columns["bits"]])
    parts = [np.flatnonzero(side == s) for s in np.unique(side)]
    trees = [Tree(sizes[p], bits[p], rests[p], groups[p]) for p in parts]
    pairs = traverse(trees[0], trees[0], True) if key[1].as_py() == key[2].as_py() else traverse(trees[0], trees[1], False) if len(trees) == 2 else ()
    left = parts[0]
    right = parts[-1]
    for i, j in pairs:
        out[0].append(classes[left[i]])
        out[1].append(classes[right[j]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    return pa.table({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})


# --- exact comparison


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted, classes, found, short = batch.column("class").to_numpy(), [], [], []
        for i, words, _ in common.words_by_text(batch.column("text")):
            hashes = common.shingles(words, SHINGLE)
            if _class_of(hashes) == wanted[i]:
                classes.append(int(wanted[i]))
                found.append(hashes.tobytes())
                short.append((hashes >> np.uint64(48)).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(found, pa.binary()), pa.array(short, pa.binary())], names=["class", "found", "short"])


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose 16-bit hashes allow the similarity: a set's hashes that the other has too bound the overlap."""
    there = np.zeros(1 << 16, bool)
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("short_a"), batch.column("short_b"), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint16), np.frombuffer(y.as_buffer(), np.uint16)
            there[b] = True
            bound = int(there[a].sum())
            there[b] = False
            keep[i] = bound >= _needed(len(a), len(b))
        kept = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("found_a"), batch.column("found_b"), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            shared = int((b[at] == a).sum())
            near[i] = 100 * shared >= LEAST * (len(a) + len(b) - shared)
        keep = pa.array(near)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        bits = [np.stack([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(f"bits_{s}")]) for s in "ab"]
        keep = pa.array(may_be_near(batch.column("n_a").to_numpy(), bits[0], batch.column("n_b").to_numpy(), bits[1]))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


class _Join:
    def __init__(self, documents: DataFrame):
        self.documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        common.arrow_limits(documents.sparkSession)
        made = written(signatures(self.documents, frequent_tokens(self.documents)), "signatures")
        self.rows = written(made.select("doc_id", "n_shingles", "class"), "rows")
        self.known = self.rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        # from here on a set is there once, however many documents have it
        grouped = made.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class")
        self.classes = written(grouped.agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")), "classes")
        forget(made)

    def _side(self, side: str, *columns: str) -> DataFrame:
        return self.classes.select(F.col("class").alias(side), *[F.col(c).alias(f"{'n' if c == 'n_shingles' else c}_{side}") for c in columns])

    def leader_pairs(self, members: DataFrame) -> DataFrame:
        """Pairs of a class and a leader that the sizes and the bitmaps allow."""
        pairs = members.where("class <> leader").select(F.col("class").alias("a"), F.col("leader").alias("b")).distinct()
        sized = pairs.join(self._side("a", "n_shingles", "bits"), "a").join(self._side("b", "n_shingles", "bits"), "b").where(f"100 * least(n_a, n_b) >= {LEAST} * greatest(n_a, n_b)")
        return sized.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(_bounded, "a long, b long")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) that have the similarity."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        places = wanted.join(self.classes, "class").select("class", F.col("first_id").alias("doc_id"))
        sets = written(self.documents.join(places, "doc_id").select("class", "text").mapInArrow(_sets, "class long, found binary, short binary").dropDuplicates(["class"]), "sets")

        def with_sets(found: DataFrame, column: str) -> DataFrame:
            a, b = (sets.select(F.col("class").alias(s), F.col(column).alias(f"{column}_{s}")) for s in "ab")
            return found.join(a, "a").join(b, "b").select("a", "b", f"{column}_a", f"{column}_b")

        # a quarter of a set's bytes settles nearly all pairs that are not near
        allowed = written(with_sets(pairs, "short").mapInArrow(_shorten, "a long, b long"), "pairs")
        out = written(with_sets(allowed, "found").mapInArrow(_compare, "a long, b long"), "near")
        forget(sets)
        forget(allowed)
        return out

    def reaching(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """(token, class, component, n_shingles, rest) of members that may be near to one of another component of their bucket."""
        rows = members.join(roots, F.col("class") == F.col("node"), "left").select("token", "class", F.coalesce("root", "class").alias("component"), "n_shingles", "rest")
        # an overlap of rest at most suffices for partners of this size at most
        rows = rows.withColumn("reach", F.floor(F.col("rest") * (100 + LEAST) / LEAST).cast("long") - F.col("n_shingles"))
        parts = written(rows.groupBy("token", "component").agg(F.count("*").alias("n"), F.min("n_shingles").alias("least"), F.max("reach").alias("most")), "parts")
        several = parts.groupBy("token").agg(F.count("*").alias("k"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.min("least").alias("least"), F.max("most").alias("most")).where("k > 1").drop("k")
        # those of the largest component need one outside of it, the others any
        outside = parts.join(several.select("token", "largest"), "token").where("component <> largest").groupBy("token").agg(F.min("least").alias("least_out"), F.max("most").alias("most_out"))
        bounds = written(several.join(outside, "token"), "bounds")
        inside = F.col("component") == F.col("largest")
        least, most = (F.when(inside, F.col(f"{c}_out")).otherwise(F.col(c)) for c in ("least", "most"))
        out = written(rows.join(bounds, "token").where((least <= F.col("reach")) & (most >= F.col("n_shingles"))).select("token", "class", "component", "n_shingles", "rest"), "reaching")
        forget(parts)
        forget(bounds)
        return out

    def tree_pairs(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Candidate pairs between components, by trees over the buckets that hold several."""
        grouped = self.reaching(members, roots)
        lists = grouped.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n"), F.min(F.col("n_shingles") - F.col("rest")).alias("place"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("members")).where("c0 < c1")
        # tokens with the same members (those of one passage) make one bucket, that of the first in the order of tokens
        buckets = lists.groupBy("members", "n").agg(F.min_by("token", F.struct("place", "token")).alias("token")).select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        rows = grouped.join(buckets, "token").join(self.classes.select("class", "bits"), "class").withColumn("own", F.pmod(F.xxhash64("class", "token"), F.col("blocks")).cast("int"))
        dealt = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class", "component", "n_shingles", "rest", "bits", F.col("own").alias("side"))
        return dealt.groupBy("token", "i", "j").applyInArrow(_tree_pairs, "a long, b long").distinct()

    def links(self) -> DataFrame:
        """Links between classes: enough of them for exact components."""
        tokens = self.classes.select("class", "n_shingles", F.posexplode("prefix").alias("place", "token")).select("token", "class", "n_shingles", (F.col("n_shingles") - F.col("place")).alias("rest"))
        several = written(tokens.groupBy("token").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 < c1").select("token"), "tokens")
        members = written(tokens.join(several, "token"), "buckets")
        forget(several)
        leaders = members.groupBy("token").agg(F.max_by("class", F.struct(F.col("rest") / F.col("n_shingles"), "class")).alias("leader"))
        shared = members.join(leaders, "token").where("class <> leader").groupBy("class", "leader").count()
        near = self.compared(written(self.leader_pairs(shared.groupBy("class").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))), "pairs"))
        more = self.compared(written(self.tree_pairs(members, components(near)), "pairs"))
        forget(members)
        return near.unionByName(more)

    def result(self) -> DataFrame:
        classes = self.classes.select("class", "first_id")
        # a document is a node: rows that share a doc_id belong together, whatever their texts
        by_id = self.known.select("class", "doc_id").distinct().join(classes, "class").where("doc_id <> first_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
        a, b = (classes.select(F.col("class").alias(s), F.col("first_id").alias(f"id_{s}")) for s in "ab")
        linked = self.links().join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        roots = components(linked.unionByName(by_id))
        rows = self.rows.select("doc_id", "n_shingles")
        return rows.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "doc_id")).alias("component_id"))


def near_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of documents(doc_id, text)."""
    return _Join(documents).result()
