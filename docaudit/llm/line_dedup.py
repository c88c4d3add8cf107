"""Fuzzy line deduplication: one line stays of each group of near-equal lines of a corpus. DataFrame operations only.

Lines are compared in lower case, without white space at their ends, by their shingles: the SHINGLE characters from each
place on (a shorter line is its only shingle).
1. Minima of BANDS x ROWS hashes of all shingles, aggregated as the shingles stream by, CHUNK at a time; ROWS of them are a
   bucket's key. All but the last row of each band come first; only lines that share those of a band with another line can
   meet in a bucket, and get the last row too.
2. Each member of a bucket is compared with its leader, the line in the largest buckets of all, of equals the most frequent
   one (of a group of copies the one with the fewest changes). Near lines are joined into components; buckets of one component
   are done.
3. In buckets of PAIRED members at most, pairs of different components are compared. A larger bucket is divided by what its
   members have besides their leader: near lines share one of the first of these shingles (a prefix, as of a frequency
   order), or so much of the leader that sizes and overlaps allow it; both are grouped and divided again if large. Only if
   that no longer divides them, their pairs are compared in blocks.
4. A pair that agrees in AGREE minima counts as near if the exact Jaccard similarity of its sets of shingles is LEAST per
   cent or more. Union-find over the pairs; of each component the first line (by doc_id, document and place) stays.

Defined results: null text has no lines; blank lines always stay; documents are told apart by doc_id and text, so rows that
share a doc_id or have none are different documents if their texts differ, and repeated rows count as one, whose lines stay
or go together; a null doc_id comes first; equal places are a tie that a hash of the document settles; an empty table gives
none; other columns are kept as they are.
"""

from __future__ import annotations

from functools import reduce
from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written
from .components import components

SHINGLE, BANDS, ROWS, LEAST, CHUNK = 12, 8, 3, 75, 16
#: Members of a bucket up to which all its pairs are compared, lines of a block where that is so in larger ones, and keys
#: that may be broadcast (their number is checked).
PAIRED, BLOCK, FEW = 32, 256, 200_000
#: Large buckets are divided while they hold more pairs than FEW_PAIRS for each member of a bucket, which is linear work, and
#: a division takes away the share DIVIDED of them; what is left is compared in blocks.
FEW_PAIRS, DIVIDED = 8, 0.25
#: Shingles that a task of a division deals out: its tasks grow in number with the work, and are even.
DEALT = 1 << 14
#: Minima of BANDS x ROWS (24) in which a pair must agree before its lines are compared: near pairs agree in 18 on average.
AGREE = 11
#: Odd factors of the hashes; multiplied modulo 2 ** 32, unlike XOR, they order the shingles independently of each other.
_FACTORS = [Random(7 + k).randrange(1 << 30, 1 << 31) | 1 for k in range(BANDS * ROWS)]
#: The factors of all rows of each band but the last one.
_FIRST = [x for k, x in enumerate(_FACTORS) if k % ROWS < ROWS - 1]
#: Stands for a null doc_id in the order of documents.
_NO_ID = -(1 << 63)
#: White space at the ends of lines.
_BLANK = " \t\r\x0b\x0c"


def _row() -> Column:
    """Tells documents apart."""
    return F.xxhash64("doc_id", "text")


def lines(documents: DataFrame) -> DataFrame:
    """(row, doc_id, line_no, line, key) of every line that is not blank; line as it is compared, key its hash."""
    split = documents.select(_row().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # trimming from the right reads every character, so it is left to lines that need it
    open_ended = reduce(Column.__or__, [at("line", F.lit(x)) for x in _BLANK for at in (F.startswith, F.endswith)])
    trimmed = F.when(open_ended, F.btrim("line", F.lit(_BLANK))).otherwise(F.col("line"))
    return split.where(F.ltrim("line", F.lit(_BLANK)) != "").withColumn("line", F.lower(trimmed)).withColumn("key", F.xxhash64("line"))


def _signatures(found: DataFrame, factors: list[int] = _FACTORS) -> DataFrame:
    """(key, minima) of each distinct line, a minimum for each factor.

    A shingle is a piece of UTF-16 units, as substring of bytes takes the same time at each place. A row is CHUNK shingles (the
    last one again where the line ends), whose least hashes meet the aggregation's buffer once.
    """
    units = found.select("key", F.encode("line", "UTF-16BE").alias("units"))
    units = units.withColumn("last", F.greatest(F.lit(0), F.floor(F.octet_length("units") / 2).cast("int") - SHINGLE))
    streamed = units.select("key", "units", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(CHUNK))).alias("at"))
    shingle = lambda j: F.substring(F.col("units"), 2 * F.least(F.col("at") + j, F.col("last")) + 1, F.lit(2 * SHINGLE))
    hashed = streamed.select("key", *[F.hash(shingle(j)).cast("long").alias(f"h{j}") for j in range(CHUNK)])
    minima = [F.min(F.least(*[(F.col(f"h{j}") * F.lit(x)).bitwiseAND(F.lit(0xFFFFFFFF)) for j in range(CHUNK)])).alias(f"m{k}") for k, x in enumerate(factors)]
    return hashed.groupBy("key").agg(*minima).select("key", F.array(*[(F.col(f"m{k}") - F.lit(1 << 31)).cast("int") for k in range(len(factors))]).alias("minima"))


def _of(rows: DataFrame, keys: DataFrame, on: str = "key") -> DataFrame:
    """rows joined with keys; these are broadcast if they are few, which is checked, else both are shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, on)


def _buckets(signatures: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Buckets (band, low, high, many) of several lines, and their members (band, key, many); a band has rows of the minima."""
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col("minima")[b * rows + r] for r in range(rows)]) for b in range(BANDS)])
    buckets = signatures.select(F.explode(bands).alias("band"), "key")
    several = written(buckets.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("many")).where("many > 1"), "line-bands")
    # a bucket of two is known by its ends; the others' members come by a join, without a shuffle if the buckets are few
    larger = several.where("many > 2").select("band", "many")
    two = several.where("many = 2").select("band", F.explode(F.array("low", "high")).alias("key"), "many")
    return several, written(_of(buckets, larger, "band").select("band", "key", "many").unionByName(two), "line-buckets")


def _texts(found: DataFrame) -> DataFrame:
    """(key, line, occurs, places, sketch) of each distinct line that may meet another one in a bucket.

    sketch: the distinct 16-bit hashes of the shingles at its places; null with characters beyond the basic plane, which are
    two units.
    """
    signatures = written(_signatures(found, _FIRST), "line-signatures")
    several, members = _buckets(signatures, ROWS - 1)
    keys = written(members.select("key").distinct(), "line-keys")
    texts = _of(found.select("key", "line"), keys).groupBy("key").agg(F.first("line").alias("line"), F.count("*").alias("occurs"))
    texts = texts.withColumn("places", F.greatest(F.lit(1), F.floor(F.octet_length(F.encode("line", "UTF-16BE")) / 2).cast("int") - SHINGLE + 1))
    # the one-element array binds the units, which are not encoded again for each place
    hashed = lambda units: F.transform(F.sequence(F.lit(0), F.col("places") - 1), lambda at: F.shiftright(F.hash(F.substring(units, 2 * at + 1, F.lit(2 * SHINGLE))), 16).cast("short"))
    each = F.transform(F.array(F.encode("line", "UTF-16BE")), hashed)[0]
    sketch = F.when(F.octet_length(F.encode("line", "UTF-16BE")) == 2 * F.length("line"), F.array_distinct(each))
    out = written(texts.select("key", "line", "occurs", "places", sketch.alias("sketch")), "line-texts")
    for done in (signatures, several, members, keys):
        forget(done)
    return out


def _same(a: str, b: str) -> Column:
    return reduce(Column.__add__, [(F.col(a)[k] == F.col(b)[k]).cast("int") for k in range(BANDS * ROWS)])


def _agreeing(pairs: DataFrame, minima: DataFrame) -> DataFrame:
    """pairs(a, b) that agree in enough minima: a pair of J 0.75 does but for one in two thousand."""
    a, b = (minima.select(F.col("key").alias(s), F.col("minima").alias(f"m_{s}")) for s in "ab")
    return pairs.join(a, "a").join(b, "b").where(_same("m_a", "m_b") >= AGREE).select("a", "b")


def _shingles(line: str) -> Column:
    """The set of a line's shingles; a look-ahead finds one at each place. Characters beyond the basic plane count as two."""
    each = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))
    return F.array_distinct(F.when(F.length(line) >= SHINGLE, each).otherwise(F.array(line)))


def _with_lines(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs with line_a and line_b."""
    a, b = (texts.select(F.col("key").alias(s), F.col("line").alias(f"line_{s}")) for s in "ab")
    # few bytes and much work: a fixed number of partitions keeps them from being joined into one task
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.join(a, "a").repartition(tasks, "b").join(b, "b")


def _of_sets(use) -> Column:
    """use(set of line_a, set of line_b, size of what they share), each computed once: a filter repeats what it reads otherwise."""
    sets = F.array(F.struct(_shingles("line_a").alias("x"), _shingles("line_b").alias("y")))
    return F.transform(sets, lambda s: F.transform(F.array(F.size(F.array_intersect(s["x"], s["y"]))), lambda k: use(s["x"], s["y"], k))[0])[0]


def _likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) that may have the similarity by their sketches, without loss.

    Hashes that only one line has stem from as many shingles, at least, that the other one lacks, and a line has no more
    shingles than places.
    """
    a, b = (texts.select(F.col("key").alias(s), F.col("sketch").alias(f"sketch_{s}"), (F.col("places") - F.size("sketch")).alias(f"more_{s}")) for s in "ab")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = (100 + LEAST) * F.size(F.array_intersect("sketch_a", "sketch_b")) >= LEAST * (F.size("sketch_a") + F.size("sketch_b")) - (100 - LEAST) * F.least("more_a", "more_b")
    unknown = F.col("sketch_a").isNull() | F.col("sketch_b").isNull()
    return pairs.join(a, "a").repartition(tasks, "b").join(b, "b").where(unknown | bound).select("a", "b")


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) whose lines have the similarity, as a table."""
    likely = written(_likely(pairs, texts), "line-likely")
    near = _with_lines(likely, texts).where(_of_sets(lambda x, y, k: 100 * k >= LEAST * (F.size(x) + F.size(y) - k))).select("a", "b")
    out = written(near, "line-links")
    forget(likely)
    return out


def _grouped(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members(band, key, ...) with their component."""
    joined = members.join(roots, F.col("key") == F.col("node"), "left")
    return joined.select(*members.columns, F.coalesce("root", "key").alias("component"))


def _reaching(members: DataFrame) -> DataFrame:
    """Those of members(band, key, component, n, rest) that may be near to one of another component of their bucket.

    A near pair overlaps in its first common shingle and what stands after it, so rest bounds the size of a partner.
    """
    rows = members.withColumn("reach", F.floor(F.col("rest") * (100 + LEAST) / LEAST).cast("long") - F.col("n"))
    parts = rows.groupBy("band", "component").agg(F.count("*").alias("many"), F.min("n").alias("least"), F.max("reach").alias("most"))
    parts = written(parts, "line-parts")
    several = parts.groupBy("band").agg(F.count("*").alias("k"), F.max(F.struct("many", "component")).alias("top"), F.min("least").alias("least"), F.max("most").alias("most")).where("k > 1")
    several = several.select("band", F.col("top.component").alias("largest"), "least", "most")
    outside = parts.join(several.select("band", "largest"), "band").where("component <> largest").groupBy("band").agg(F.min("least").alias("least_out"), F.max("most").alias("most_out"))
    bounds = written(several.join(outside, "band"), "line-bounds")
    inside = F.col("component") == F.col("largest")
    least, most = (F.when(inside, F.col(f"{c}_out")).otherwise(F.col(c)) for c in ("least", "most"))
    return _of(rows, bounds, "band").where((least <= F.col("reach")) & (most >= F.col("n"))).select(*members.columns)


def _pairs(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components of each bucket of sizes(band, many), dealt out in pairs of blocks if it is large."""
    blocks = F.ceil(F.col("many") / F.lit(BLOCK)).cast("long")
    dealt = _of(members, sizes, "band").select("band", "key", "component", "n", "rest", F.pmod(F.xxhash64("key"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    a, b = (dealt.where(F.col("own") == F.col(own)).select(F.col("key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("band", "low", "high", "component", "n", "rest")]) for s, own in (("a", "low"), ("b", "high")))
    cell = (F.col("band_a") == F.col("band_b")) & (F.col("low_a") == F.col("low_b")) & (F.col("high_a") == F.col("high_b"))
    once = (F.col("low_a") < F.col("high_a")) | (F.col("a") > F.col("b"))
    overlap = (100 + LEAST) * F.least("rest_a", "rest_b") >= LEAST * (F.col("n_a") + F.col("n_b"))
    pair = a.join(b, cell & once & (F.col("component_a") != F.col("component_b")) & overlap)
    return pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(own, ...) dealt out one by one over tasks of about DEALT shingles, as the rows of a leader or of a key lie together."""
    total = rows.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0]
    return rows.repartition(total // DEALT + 1)


def _divided(members: DataFrame, scores: DataFrame, texts: DataFrame) -> DataFrame:
    """(band, key, component, n, rest) of smaller buckets that hold all near pairs of different components of members.

    A bucket's leader is a member of the highest score. In an order of shingles that puts the leader's last, first those that
    only one component of its followers has and between them those of fewer followers first, two near lines share one of the
    first quarter; so a bucket for each such shingle that is not the leader's, and one for the leader's.
    """
    scored = members.join(scores, "key")
    leaders = scored.groupBy("band").agg(F.max(F.struct("score", "occurs", "key")).alias("top")).select("band", F.col("top.key").alias("leader"))
    leaders = written(leaders, "line-leaders")
    led = written(_of(members, leaders, "band").select(F.col("key").alias("a"), F.col("leader").alias("b"), "component").distinct(), "line-led")
    others = lambda x, y: F.transform(F.array_except(x, y), lambda t: F.xxhash64(t))
    measured = _of_sets(lambda x, y, k: F.struct(F.size(x).cast("long").alias("n"), k.cast("long").alias("shared"), others(x, y).alias("own")))
    own = written(_with_lines(led, texts).select(F.col("a").alias("key"), F.col("b").alias("leader"), "component", measured.alias("m")).select("key", "leader", "component", "m.*"), "line-own")
    each = _dealt(own).select("leader", "key", "component", "n", F.size("own").alias("owns"), F.explode("own").alias("shingle"))
    each = each.select(F.xxhash64("leader", "shingle").alias("band"), "leader", "key", "component", "n", "owns")
    # shingles of one component, which are most, go before any are joined
    shared = written(each.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("followers")).where("c0 < c1").select("band", "followers"), "line-shared")
    of_line = Window.partitionBy("leader", "key")
    ranked = _of(each, shared, "band").withColumns({"rank": F.row_number().over(of_line.orderBy("followers", "band")), "several": F.count("*").over(of_line)})
    besides = ranked.withColumn("place", F.col("owns") - F.col("several") + F.col("rank") - 1).where(F.col("place") < F.col("n") - F.ceil(F.col("n") * LEAST / 100) + 1)
    besides = besides.select("leader", "band", "key", "component", "n", (F.col("n") - F.col("place")).alias("rest"))
    core = own.where("shared > 0").select("leader", F.xxhash64("leader", F.lit("core")).alias("band"), "key", "component", "n", F.col("shared").alias("rest"))
    held = written(besides.unionByName(core), "line-mixed")
    rows = written(_reaching(held), "line-divided")
    # of a leader's buckets with the same members (copies have many in common) the first in its order stands for all
    lists = rows.groupBy("leader", "band").agg(F.count("*").alias("many"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("members"), F.min(F.col("n") - F.col("rest")).alias("place"))
    first_of = lists.groupBy("leader", "members", "many").agg(F.min(F.struct("place", "band")).alias("first")).select(F.col("first.band").alias("band"))
    out = written(rows.drop("leader").join(written(first_of, "line-firsts"), "band"), "line-buckets")
    for done in (leaders, led, own, shared, held, rows):
        forget(done)
    return out


def near_links(texts: DataFrame) -> DataFrame:
    """Links between keys of near lines of _texts(): enough of them for the components of all near pairs that share a bucket."""
    minima = written(_signatures(texts), "line-minima")
    several, members = _buckets(minima, ROWS)
    scores = written(members.groupBy("key").agg(F.sum("many").alias("score")).join(texts.select("key", "occurs"), "key"), "line-scores")
    tops = members.where("many > 2").join(scores, "key").groupBy("band").agg(F.max(F.struct("score", "occurs", "key")).alias("top")).select("band", F.col("top.key").alias("leader"))
    led = members.join(tops, "band").where("key <> leader").select(F.greatest("key", "leader").alias("a"), F.least("key", "leader").alias("b"))
    led = led.unionByName(several.where("many = 2").select(F.col("high").alias("a"), F.col("low").alias("b"))).distinct()
    tested = written(_agreeing(led, minima), "line-pairs")
    links = _near(tested, texts)
    rows = _grouped(members.where("many > 2").select("band", "key"), components(links)).withColumns({"n": F.lit(1).cast("long"), "rest": F.lit(1).cast("long")})
    # sizes are unknown at first: all are 1, so that nothing but components is told apart
    rows, before, enough = written(_reaching(rows), "line-buckets"), None, None
    forget(several)
    forget(members)
    while True:
        sizes = written(rows.groupBy("band").agg(F.count("*").alias("many"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("band", "many"), "line-sizes")
        large = sizes.where(F.col("many") > PAIRED)
        enough = enough or FEW_PAIRS * rows.count()
        most = large.agg(F.coalesce(F.sum(F.col("many").cast("double") ** 2), F.lit(0.0))).first()[0]
        divides = most > enough and (before is None or most <= (1 - DIVIDED) * before)
        pairs = _agreeing(_pairs(rows, sizes.where(F.col("many") <= PAIRED) if divides else sizes), minima).join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "line-pairs")
        links = links.unionByName(_near(pairs, texts))
        if not divides:
            break
        left = written(_grouped(_of(rows, large.select("band"), "band").select("band", "key"), components(links)), "line-left")
        for done in (rows, sizes, pairs):
            forget(done)
        rows, before = _divided(left, scores, texts), most
        forget(left)
    for done in (minima, scores, tested, rows, sizes, pairs):
        forget(done)
    return links


def removed_lines(documents: DataFrame) -> DataFrame:
    """(row, doc_id, line_no) of every line that goes; a null doc_id as _NO_ID."""
    found = lines(documents)
    texts = _texts(found)
    roots = components(near_links(texts))
    forget(texts)
    grouped = written(found.select("row", "doc_id", "line_no", "key").join(roots, F.col("key") == F.col("node"), "left").select("row", "doc_id", "line_no", F.coalesce("root", "key").alias("group")), "line-groups")
    first = grouped.groupBy("group").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1").select("group", "keep_id")
    several = written(grouped.join(first, "group"), "line-several")
    forget(grouped)
    keep = several.where("doc_id = keep_id").groupBy("group").agg(F.min(F.struct("row", "line_no")).alias("keep")).select("group", F.col("keep.row").alias("keep_row"), F.col("keep.line_no").alias("keep_no"))
    return several.join(keep, "group").where("row <> keep_row OR line_no <> keep_no").select("row", "doc_id", "line_no")


def _by_document(removed: DataFrame) -> DataFrame:
    return removed.groupBy("row").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def removals(documents: DataFrame) -> DataFrame:
    """Per document: its number of lines, of those removed, and their places (from 0)."""
    sizes = documents.select(_row().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    out = sizes.join(_by_document(written(removed_lines(documents), "removed-lines")), "row", "left")
    places = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(places).cast("long").alias("n_removed"), places.alias("removed"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """documents with their columns, without the lines that go; documents that lose every line go too."""
    removed = _by_document(written(removed_lines(documents), "removed-lines")).withColumnRenamed("row", "_row").withColumnRenamed("removed", "_removed")
    out = documents.withColumn("_row", _row()).join(removed, "_row", "left")

    def without(parts: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_removed"))
        return F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")

    # the one-element array binds the split text, which is not split again for each line
    left = F.transform(F.array(F.split("text", "\n")), without)[0]
    out = out.withColumn("_left", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(left)).where(F.col("_removed").isNull() | (F.length(F.btrim("_left", F.lit(" \t\r\n\x0b\x0c"))) > 0))
    return out.withColumn("text", F.col("_left")).select(*documents.columns)
