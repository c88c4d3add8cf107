"""Queries over the driver tables, one for each operator, and the SQL that gives the same rows.

Stand-ins map driver columns onto the fields of office documents: a line is a paragraph, five texts in a row are a batch,
an embedding's 64 numbers are an image's 64 DCT coefficients, a line item is a run, an event is a task's event.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Annotation, FormatCheck, ImageCompare, Style, TextCompare
from ..functions import image as im
from ..functions.text import comparable, ngrams, once, rounded
from ..operators import annotate, audit, diff, format_check, image_compare, interference, report, requests, scoring, sections, semantic, stylometry, text_compare
from ..sources import tables
from . import fixtures

TEXT, IMAGE, FORMAT, STYLE = TextCompare(), ImageCompare(), FormatCheck(), Style()
#: Words of the driver's invented prose that stand in for the lexicons.
STAND_INS = {"responses": ("that the ", "avec des", "zu der"), "transitions": ("the", "que", "und"), "generic": ("tion", "heit", "ment")}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:  # a step that several others read is computed once
            ORACLES[f.__name__] = re.sub(r"\b(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", sql)
        return f

    return add


# --- paragraphs

DOCS = "docs AS (SELECT doc_id, doc_id // 5 AS batch, sha256(text) AS sha, text FROM documents WHERE text IS NOT NULL)"
PARAS = DOCS + r""",
raw AS (SELECT doc_id, batch, sha, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS raw_index FROM docs),
normed AS (SELECT doc_id, batch, sha, raw_index, regexp_replace(regexp_replace(translate(t, chr(160) || chr(12288), '  '), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM raw),
paras AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw_index) - 1 AS ord FROM normed WHERE length(text) > 0),
marked AS (SELECT *, printf('p-%06d', ord + 1) AS paragraph_id, CASE WHEN length(text) < 40 THEN 1 + length(text) % 3 END AS heading_level FROM paras),
judged AS (SELECT *, CASE WHEN heading_level IS NOT NULL THEN 'heading' WHEN length(trim(text)) < 8 THEN 'short_noise' WHEN regexp_matches(text, '(?i)that the |avec des|zu der') THEN 'standard_response' END AS category FROM marked)"""
ELIGIBLE = PARAS + """,
elig AS (SELECT *, length(norm) AS char_count, CASE WHEN category = 'standard_response' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM (SELECT *, substr(lower(regexp_replace(text, '[^一-鿿A-Za-z0-9]+', '', 'g')), 1, 6000) AS norm FROM judged)
  WHERE heading_level IS NULL AND coalesce(category, '') NOT IN ('heading', 'short_noise') AND length(norm) >= 20)"""


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.paragraphs(tables.dealt(tables.documents(spark, sf_dir), "doc_id"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with a stand-in heading level: short lines are headings of level 1 to 3."""
    short = F.length("text") < 40
    return _paragraphs(spark, sf_dir).withColumn("heading_level", F.when(short, (1 + F.length("text") % 3).cast("int")))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_compare.prepared(sections.section_paths(_marked(spark, sf_dir)), TEXT, responses=STAND_INS["responses"])


@query(f"WITH {PARAS} SELECT doc_id, batch, 'doc-' || substr(sha, 1, 24) AS document_id, ord, paragraph_id, raw_index, text FROM marked")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir).select("doc_id", "batch", "document_id", "ord", "paragraph_id", "raw_index", "text")


@query(f"WITH {DOCS} SELECT doc_id, 'doc-' || substr(sha, 1, 24) AS document_id, sha AS sha256, strlen(text) AS file_size_bytes FROM docs")
def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).select("doc_id", "document_id", "sha256", "file_size_bytes")


@query(f"""WITH {PARAS}, n AS (SELECT doc_id, ord, lower(regexp_replace(text, '[^一-鿿A-Za-z0-9]+', '', 'g')) AS normalized FROM marked)
SELECT doc_id, ord, normalized, greatest(length(normalized) - 1, 0) + greatest(length(normalized) - 2, 0) AS grams,
  len(list_distinct(list_transform(range(1, greatest(length(normalized) - 1, 1)), lambda i: substr(normalized, i, 3)))) AS distinct_trigrams FROM n""")
def normalize_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paragraphs(spark, sf_dir).select("doc_id", "ord", comparable(F.col("text")).alias("normalized"))
    return rows.select("doc_id", "ord", "normalized", F.size(ngrams(F.col("normalized"), 2, 3)).cast("long").alias("grams"), F.size(F.array_distinct(ngrams(F.col("normalized"), 3, 3))).cast("long").alias("distinct_trigrams"))


@query(f"WITH {PARAS} SELECT doc_id, paragraph_id, category, CASE WHEN category = 'standard_response' THEN 'downweight' ELSE 'exclude' END AS action, 'int-' || substr(sha256(sha || '|' || paragraph_id || '|' || category), 1, 24) AS finding_id FROM judged WHERE category IS NOT NULL")
def interference_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interference.items(_marked(spark, sf_dir), responses=STAND_INS["responses"]).drop("document_id")


@query(f"WITH {PARAS} SELECT doc_id, count(*) AS paragraphs, count(category) AS items, count(*) FILTER (category IN ('heading', 'short_noise')) AS excluded, count(*) FILTER (category = 'standard_response') AS downweighted FROM judged GROUP BY doc_id")
def interference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interference.summary(_marked(spark, sf_dir), responses=STAND_INS["responses"])


@query(f"WITH {ELIGIBLE} SELECT doc_id, ord, norm AS normalized, char_count, weight FROM elig")
def eligible_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select("doc_id", "ord", "normalized", F.col("char_count").cast("long").alias("char_count"), "weight")


SECTIONS = PARAS + """,
lasts AS (SELECT *, """ + ", ".join(f"last_value(CASE WHEN heading_level = {k} THEN text END IGNORE NULLS) OVER w AS n{k}, max(CASE WHEN heading_level = {k} THEN ord END) OVER w AS p{k}" for k in (1, 2, 3)) + """
  FROM judged WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sect AS (SELECT *, coalesce(nullif(concat_ws(' / ', n1, CASE WHEN p2 > coalesce(p1, -1) THEN n2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN n3 END), ''), '正文') AS section FROM lasts)"""


@query(f"WITH {SECTIONS} SELECT doc_id, ord, section FROM sect")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.section_paths(_marked(spark, sf_dir)).select("doc_id", "ord", "section")


# --- text comparison

RECALL = ELIGIBLE + """,
bi AS (SELECT batch, doc_id, ord, unnest(list_distinct(list_transform(range(1, length(norm)), lambda i: substr(norm, i, 2)))) AS g FROM elig),
sz AS (SELECT doc_id, ord, count(*) AS n FROM bi GROUP BY ALL),
sh AS (SELECT l.batch, l.doc_id AS left_doc, r.doc_id AS right_doc, l.ord AS left_ord, r.ord AS right_ord, count(*) AS shared FROM bi l JOIN bi r ON l.batch = r.batch AND l.g = r.g AND l.doc_id < r.doc_id GROUP BY ALL HAVING count(*) >= 2),
jac AS (SELECT sh.*, shared / (a.n + b.n - shared) AS j FROM sh JOIN sz a ON a.doc_id = left_doc AND a.ord = left_ord JOIN sz b ON b.doc_id = right_doc AND b.ord = right_ord),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_doc, right_doc, left_ord ORDER BY j DESC, right_ord) AS candidate_rank FROM jac) WHERE candidate_rank <= 30)"""
# one join of the tokens of a batch gives what the pairs share: bigrams for recall, trigrams for containment, weights for the cosine
LEXICAL = ELIGIBLE + """,
gr AS (SELECT batch, doc_id, ord, unnest(list_concat(list_transform(range(1, length(norm)), lambda i: substr(norm, i, 2)), list_concat(list_transform(range(1, length(norm) - 1), lambda i: substr(norm, i, 3)), list_transform(range(1, length(norm) - 2), lambda i: substr(norm, i, 4))))) AS g FROM elig),
tf AS (SELECT batch, doc_id, ord, g, count(*) AS c FROM gr GROUP BY ALL),
ddf AS (SELECT doc_id, g, count(*) AS n FROM tf GROUP BY ALL),
np AS (SELECT batch, doc_id, count(*) AS n FROM elig GROUP BY ALL),
tfd AS (SELECT tf.batch, tf.doc_id, ord, tf.g, length(tf.g) AS k, c, ddf.n AS df, np.n AS total FROM tf JOIN ddf ON ddf.doc_id = tf.doc_id AND ddf.g = tf.g JOIN np ON np.doc_id = tf.doc_id),
sz AS (SELECT doc_id, ord, count(*) FILTER (k = 2) AS n, count(*) FILTER (k = 3) AS n3 FROM tfd GROUP BY ALL),
sh AS (SELECT l.batch, l.doc_id AS left_doc, r.doc_id AS right_doc, l.ord AS left_ord, r.ord AS right_ord, count(*) FILTER (l.k = 2) AS shared, count(*) FILTER (l.k = 3) AS shared3, sum(l.c * r.c * (ln((1 + l.total + r.total) / (1 + l.df + r.df)) + 1) ^ 2) AS dot
  FROM tfd l JOIN tfd r ON l.batch = r.batch AND l.g = r.g AND l.doc_id < r.doc_id GROUP BY ALL HAVING count(*) FILTER (l.k = 2) >= 2),
jac AS (SELECT sh.*, shared / (a.n + b.n - shared) AS j, shared3 / least(a.n3, b.n3) AS cont FROM sh JOIN sz a ON a.doc_id = left_doc AND a.ord = left_ord JOIN sz b ON b.doc_id = right_doc AND b.ord = right_ord),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_doc, right_doc, left_ord ORDER BY j DESC, right_ord) AS candidate_rank FROM jac) WHERE candidate_rank <= 30),
nl AS (SELECT t.doc_id, o.doc_id AS other, t.ord, sqrt(sum((c * (ln((1 + t.total + o.n) / (1 + t.df + coalesce(d.n, 0))) + 1)) ^ 2)) AS norm FROM tfd t JOIN np o ON o.batch = t.batch AND o.doc_id <> t.doc_id LEFT JOIN ddf d ON d.doc_id = o.doc_id AND d.g = t.g GROUP BY ALL),
lex AS (SELECT c.*, least(1.0, dot / (a.norm * b.norm)) AS cosine, least(e.weight, f.weight) AS factor
  FROM cand c JOIN nl a ON a.doc_id = c.left_doc AND a.other = c.right_doc AND a.ord = c.left_ord JOIN nl b ON b.doc_id = c.right_doc AND b.other = c.left_doc AND b.ord = c.right_ord
  JOIN elig e ON e.doc_id = c.left_doc AND e.ord = c.left_ord JOIN elig f ON f.doc_id = c.right_doc AND f.ord = c.right_ord),
sc AS (SELECT batch, left_doc, right_doc, left_ord, right_ord, shared, candidate_rank, round_even(j, 6) AS jaccard, round_even(cosine, 6) AS tfidf_cosine, round_even(cont, 6) AS containment, round_even(greatest(cosine, cont), 6) AS raw_score, factor, round_even(greatest(cosine, cont) * factor, 6) AS score FROM lex)"""
FINDINGS = LEXICAL + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_doc, right_doc, left_ord ORDER BY score DESC, right_ord) AS match_rank FROM sc WHERE score >= 0.6) WHERE match_rank <= 3),
ft AS (SELECT t.*, 'txt-' || substr(sha256(a.sha || '|' || a.paragraph_id || '|' || b.sha || '|' || b.paragraph_id), 1, 24) AS finding_id, CASE WHEN score >= 0.85 THEN 'high' ELSE 'medium' END AS severity,
  row_number() OVER (PARTITION BY left_doc, right_doc ORDER BY score DESC, left_ord, right_ord) AS rank, a.char_count AS left_chars, b.char_count AS right_chars, 'doc-' || substr(a.sha, 1, 24) AS left_document_id, 'doc-' || substr(b.sha, 1, 24) AS right_document_id
  FROM top t JOIN elig a ON a.doc_id = left_doc AND a.ord = left_ord JOIN elig b ON b.doc_id = right_doc AND b.ord = right_ord),
docpairs AS (SELECT a.batch, a.doc_id AS left_doc, b.doc_id AS right_doc FROM docs a JOIN docs b ON a.batch = b.batch AND a.doc_id < b.doc_id)"""


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prepared = _prepared(spark, sf_dir)
    return text_compare.scores(prepared, TEXT, sequence=False), prepared


def _findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # several branches read both; what is lost with an executor is computed again
    prepared = _prepared(spark, sf_dir).select(*text_compare.COMPARED).persist()
    found = text_compare.findings(text_compare.scores(prepared, TEXT, sequence=False, least=TEXT.medium), prepared, TEXT)
    return found.persist(), prepared


@query(f"WITH {RECALL} SELECT batch, left_doc, right_doc, left_ord, right_ord, shared, round_even(j, 6) AS jaccard, candidate_rank FROM cand")
def recall_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same candidates by joins and array operations alone: bigram sets of two documents of a batch."""
    rows = _prepared(spark, sf_dir).select("batch", "doc_id", "ord", F.array_distinct(ngrams(F.col("normalized"), 2, 2)).alias("g"))
    left, right = (rows.select("batch", F.col("doc_id").alias(f"{s}_doc"), F.col("ord").alias(f"{s}_ord"), F.col("g").alias(f"{s}_g")) for s in ("left", "right"))
    pairs = left.join(right, "batch").where("left_doc < right_doc").withColumn("shared", F.size(F.array_intersect("left_g", "right_g"))).where(F.col("shared") >= TEXT.min_shared)
    jaccard = F.col("shared") / (F.size("left_g") + F.size("right_g") - F.col("shared"))
    from pyspark.sql import Window

    order = Window.partitionBy("left_doc", "right_doc", "left_ord").orderBy(F.desc("j"), "right_ord")
    ranked = pairs.withColumn("j", jaccard).drop("left_g", "right_g").withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= TEXT.max_candidates)
    return ranked.select("batch", "left_doc", "right_doc", "left_ord", "right_ord", F.col("shared").cast("long").alias("shared"), rounded("j", 6).alias("jaccard"), "candidate_rank")


@query(f"WITH {LEXICAL} SELECT * EXCLUDE (shared, candidate_rank) FROM sc")
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)[0].select("batch", "left_doc", "right_doc", "left_ord", "right_ord", "jaccard", "tfidf_cosine", "containment", "raw_score", "factor", "score")


@query(f"WITH {FINDINGS} SELECT batch, finding_id, severity, left_doc, right_doc, left_ord, right_ord, score, match_rank, rank FROM ft")
def text_findings_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)[0].select("batch", "finding_id", "severity", "left_doc", "right_doc", "left_ord", "right_ord", "score", "match_rank", "rank")


@query()
def text_findings_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the sequence ratio, which SQL cannot express."""
    # the scores and both sides of the findings read it
    prepared = _prepared(spark, sf_dir).select(*text_compare.COMPARED).persist()
    found = text_compare.findings(text_compare.scores(prepared, TEXT, least=TEXT.medium), prepared, TEXT)
    return found.select("batch", "finding_id", "severity", "left_doc", "right_doc", "left_ord", "right_ord", "sequence_ratio", "score", "rank")


@query(f"WITH {FINDINGS} SELECT p.batch, p.left_doc, p.right_doc, count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'medium') AS medium_count, coalesce(max(score), 0.0) AS max_similarity FROM docpairs p LEFT JOIN ft f ON f.left_doc = p.left_doc AND f.right_doc = p.right_doc GROUP BY ALL")
def text_pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, prepared = _findings(spark, sf_dir)
    return text_compare.pair_summary(found, text_compare.document_pairs(prepared, tables.documents(spark, sf_dir)))


STATS = FINDINGS + """,
tot AS (SELECT doc_id, count(*) AS n, sum(char_count) AS c FROM elig GROUP BY doc_id),
hi AS (SELECT DISTINCT left_doc, right_doc, 'left' AS side, left_ord AS ord, left_chars AS chars FROM ft WHERE severity = 'high' UNION SELECT DISTINCT left_doc, right_doc, 'right', right_ord, right_chars FROM ft WHERE severity = 'high'),
rep AS (SELECT left_doc, right_doc, side, count(*) AS n, sum(chars) AS c FROM hi GROUP BY ALL),
sides AS (SELECT *, 'left' AS side, left_doc AS doc_id FROM docpairs UNION ALL SELECT *, 'right', right_doc FROM docpairs),
stats AS (SELECT s.batch, s.left_doc, s.right_doc, s.side, s.doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS eligible_paragraphs, CAST(coalesce(t.c, 0) AS BIGINT) AS eligible_chars, CAST(coalesce(r.n, 0) AS BIGINT) AS repeated_paragraphs, CAST(coalesce(r.c, 0) AS BIGINT) AS repeated_chars,
  CASE WHEN t.c > 0 THEN round_even(coalesce(r.c, 0) / t.c, 6) ELSE 0.0 END AS repeated_rate FROM sides s LEFT JOIN tot t USING (doc_id) LEFT JOIN rep r ON r.left_doc = s.left_doc AND r.right_doc = s.right_doc AND r.side = s.side)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, prepared = _findings(spark, sf_dir)
    return text_compare.document_stats(found, prepared, text_compare.document_pairs(prepared, tables.documents(spark, sf_dir)))


@query(f"WITH {STATS} SELECT * FROM stats")
def text_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query(f"""WITH {FINDINGS}, {SECTIONS[len(PARAS) + 2:].strip()}, named AS (SELECT f.*, a.section AS source_section, b.section AS peer_section FROM ft f JOIN sect a ON a.doc_id = left_doc AND a.ord = left_ord JOIN sect b ON b.doc_id = right_doc AND b.ord = right_ord),
g AS (SELECT batch, left_doc, right_doc, source_section, peer_section, count(*) AS pair_count, count(*) FILTER (severity = 'high') AS high_pair_count, max(score) AS max_similarity FROM named GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_doc, right_doc ORDER BY high_pair_count DESC, max_similarity DESC, pair_count DESC, source_section, peer_section) AS rank FROM g) WHERE rank <= 10""")
def top_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_compare.top_sections(_findings(spark, sf_dir)[0])


@query("""WITH p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, (a.vec_id % 10) / 10 AS lexical, greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT left_id, right_id, lexical, round_even(s, 5) AS semantic_score, greatest(lexical, round_even(s, 5)) AS raw_score FROM p""")
def semantic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.table(spark, sf_dir, "embeddings")
    pairs = vectors.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"), ((F.col("vec_id") % 10) / 10).alias("lexical"))
    return semantic.reranked(pairs, vectors)


# --- images: 64 numbers are 64 coefficients

IMAGES = """bits AS (SELECT vec_id, label, embedding::DOUBLE[] AS c FROM embeddings),
med AS (SELECT *, list_sort(c[2:64])[32] AS m FROM bits),
ph AS (SELECT vec_id, label, list_reduce(list_prepend(0::UBIGINT, list_transform(c, lambda x: CASE WHEN x > m THEN 1::UBIGINT ELSE 0::UBIGINT END)), lambda a, b: (a << 1) | b) AS whole FROM med),
img AS (SELECT vec_id, vec_id // 50 AS batch, label AS doc_id, vec_id AS image_id, whole, whole & 18442240474082181120::UBIGINT AS h, sha256(printf('%016x', whole)) AS sha256, 6 + vec_id % 100 AS width, 6 + (vec_id * 7) % 90 AS height, [vec_id % 256, (vec_id * 3) % 256, (vec_id * 11) % 256] AS rgb FROM ph),
ok AS (SELECT * FROM img WHERE width >= 8 AND height >= 8)"""
PAIRS = IMAGES + """,
pp AS (SELECT a.batch, a.doc_id AS left_doc_id, b.doc_id AS right_doc_id, a.image_id AS left_image_id, b.image_id AS right_image_id, a.sha256 = b.sha256 AS same, bit_count(xor(a.h, b.h)::BIT) AS dist,
  abs(a.width / a.height - b.width / b.height) / greatest(a.width / a.height, b.width / b.height) AS asp,
  1 - sqrt((a.rgb[1] - b.rgb[1]) ^ 2 + (a.rgb[2] - b.rgb[2]) ^ 2 + (a.rgb[3] - b.rgb[3]) ^ 2) / sqrt(3 * 255.0 ^ 2) AS col
  FROM ok a JOIN ok b ON a.batch = b.batch AND a.doc_id < b.doc_id),
mt AS (SELECT batch, left_doc_id, right_doc_id, left_image_id, right_image_id, CASE WHEN same OR dist <= 5 THEN 'exact' ELSE 'high_similar' END AS match_type, CASE WHEN same THEN 0 ELSE dist END AS distance,
  round_even(CASE WHEN same THEN 1.0 ELSE 0.85 * (1 - dist / 64.0) + 0.15 * col END, 6) AS similarity, round_even(CASE WHEN same THEN 1.0 ELSE col END, 6) AS colour_similarity, round_even(CASE WHEN same THEN 0.0 ELSE asp END, 6) AS aspect_delta,
  'img-' || substr(sha256('d' || left_doc_id || '|' || left_image_id || '|' || 'd' || right_doc_id || '|' || right_image_id), 1, 24) AS finding_id
  FROM pp WHERE same OR (asp <= 0.25 AND dist <= 15 AND col >= 0.55))"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    # bits are much work and read by every band
    rows = tables.dealt(tables.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "vec_id")
    rows = once(rows, whole=im.hash_bits(F.transform("embedding", lambda x: x.cast("double")))).drop("embedding")
    # the vectors are random: as hashes to compare, their first 12 bits
    rows = rows.withColumn("phash", F.col("whole").bitwiseAND(F.lit(-(1 << 52))))
    return rows.select(F.floor(v / 50).cast("long").alias("batch"), F.col("label").alias("doc_id"), v.alias("image_id"), F.concat(F.lit("d"), F.col("label")).alias("sha_doc"), F.sha2(im.hash_hex(F.col("whole")), 256).alias("sha256"), "phash", (6 + v % 100).alias("width"), (6 + (v * 7) % 90).alias("height"), F.array((v % 256), (v * 3) % 256, (v * 11) % 256).alias("mean_rgb"))


@query(f"WITH {IMAGES} SELECT vec_id, printf('%016x', whole) AS phash FROM img")
def phash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = im.hash_bits(F.transform("embedding", lambda x: x.cast("double")))
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", im.hash_hex(bits).alias("phash"))


@query(f"WITH {PAIRS} SELECT * FROM mt")
def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_compare.image_pairs(_images(spark, sf_dir), IMAGE)


@query(f"WITH {PAIRS} SELECT * FROM mt")
def image_pairs_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_compare.image_pairs_banded(_images(spark, sf_dir), IMAGE)


IMAGE_STATS = PAIRS + """,
idoc AS (SELECT DISTINCT batch, doc_id FROM img), inum AS (SELECT batch, doc_id, count(*) AS n FROM ok GROUP BY ALL),
irep AS (SELECT batch, left_doc_id, right_doc_id, count(DISTINCT left_image_id) AS lr, count(DISTINCT right_image_id) AS rr, count(*) FILTER (match_type = 'exact') AS ex, count(*) FILTER (match_type = 'high_similar') AS nr, max(similarity) AS top FROM mt GROUP BY ALL),
ist AS (SELECT a.batch, a.doc_id AS left_doc_id, b.doc_id AS right_doc_id, coalesce(x.n, 0) AS left_images, coalesce(y.n, 0) AS right_images, coalesce(lr, 0) AS left_repeated, coalesce(rr, 0) AS right_repeated, coalesce(ex, 0) AS "exact", coalesce(nr, 0) AS near, coalesce(top, 0.0) AS max_similarity,
  CASE WHEN x.n > 0 THEN round_even(coalesce(lr, 0) / x.n, 6) ELSE 0.0 END AS left_rate, CASE WHEN y.n > 0 THEN round_even(coalesce(rr, 0) / y.n, 6) ELSE 0.0 END AS right_rate
  FROM idoc a JOIN idoc b ON a.batch = b.batch AND a.doc_id < b.doc_id LEFT JOIN irep s ON s.batch = a.batch AND s.left_doc_id = a.doc_id AND s.right_doc_id = b.doc_id LEFT JOIN inum x ON x.batch = a.batch AND x.doc_id = a.doc_id LEFT JOIN inum y ON y.batch = b.batch AND y.doc_id = b.doc_id)"""


@query(f"WITH {IMAGE_STATS} SELECT * FROM ist")
def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    return image_compare.image_stats(image_compare.image_pairs_banded(images, IMAGE), images, IMAGE)


# --- format: a line item is a run of paragraph l_orderkey in document l_suppkey

RUNS = """runs AS (SELECT l_suppkey AS doc_id, l_orderkey AS para_id, l_returnflag AS font, round_even(l_quantity, 2) AS size, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag) AS run_ord FROM lineitem),
fc AS (SELECT doc_id, para_id, font, count(*) AS n, min(run_ord) AS f FROM runs GROUP BY ALL), zc AS (SELECT doc_id, para_id, size, count(*) AS n, min(run_ord) AS f FROM runs GROUP BY ALL),
sig AS (SELECT a.doc_id, a.para_id, font, size FROM (SELECT doc_id, para_id, font FROM fc QUALIFY row_number() OVER (PARTITION BY doc_id, para_id ORDER BY n DESC, f) = 1) a JOIN (SELECT doc_id, para_id, size FROM zc QUALIFY row_number() OVER (PARTITION BY doc_id, para_id ORDER BY n DESC, f) = 1) b ON a.doc_id = b.doc_id AND a.para_id = b.para_id),
dc AS (SELECT doc_id, font, size, count(*) AS n, min(para_id) AS f FROM sig GROUP BY ALL),
dom AS (SELECT d.doc_id, d.font AS dominant_font, d.size AS dominant_size, t.comparable, round_even(d.n / t.comparable, 6) AS dominant_ratio FROM (SELECT * FROM dc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1) d JOIN (SELECT doc_id, count(*) AS comparable FROM sig GROUP BY ALL) t USING (doc_id)),
outl AS (SELECT s.doc_id, s.para_id, s.font, s.size, dominant_font, dominant_size FROM sig s JOIN dom USING (doc_id) WHERE s.font <> dominant_font OR abs(s.size - dominant_size) > 0.5)"""


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("para_id"), F.col("l_returnflag").alias("font"), F.col("l_quantity").alias("size"), "l_linenumber", "l_partkey", "l_extendedprice")
    return format_check.run_signatures(format_check.first_seen(rows, ["l_linenumber", "l_partkey", "l_extendedprice", "size", "font"]))


@query(f"WITH {RUNS} SELECT * FROM sig")
def run_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir)


@query(f"WITH {RUNS} SELECT * FROM dom")
def dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_check.dominant_styles(_signatures(spark, sf_dir))


@query(f"WITH {RUNS} SELECT *, 'low' AS severity, 'fmt-' || substr(sha256(doc_id || '|' || para_id || '|body-style-outlier'), 1, 24) AS finding_id FROM outl")
def style_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    signatures = _signatures(spark, sf_dir)
    return format_check.style_outliers(signatures, format_check.dominant_styles(signatures), FORMAT)


FORMATS = RUNS + """, fs AS (SELECT d.doc_id, dominant_font, dominant_size, dominant_ratio, comparable, coalesce(o.n, 0) AS outliers, coalesce(o.n, 0) + CASE WHEN dominant_ratio < 0.7 THEN 1 ELSE 0 END AS issues,
  round_even(greatest(coalesce(o.n, 0) / comparable, CASE WHEN dominant_ratio < 0.7 THEN greatest(round_even(1 - dominant_ratio, 6), 0.55) ELSE 0 END, CASE WHEN o.n > 0 THEN 0.25 ELSE 0 END), 6) AS format_risk FROM dom d LEFT JOIN (SELECT doc_id, count(*) AS n FROM outl GROUP BY ALL) o USING (doc_id))"""


def _format_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    signatures = _signatures(spark, sf_dir).persist()
    dominant = format_check.dominant_styles(signatures).persist()
    return format_check.format_summary(signatures, dominant, format_check.style_outliers(signatures, dominant, FORMAT), FORMAT)


@query(f"WITH {FORMATS} SELECT * FROM fs")
def format_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _format_summary(spark, sf_dir)


@query("""WITH m AS (SELECT 's' || s_suppkey AS doc_id, s_suppkey % 7 / 10 + 2 AS l, s_nationkey % 5 / 10 + 2 AS r, CASE WHEN s_suppkey % 11 > 0 THEN 2.5 END AS t FROM supplier)
SELECT doc_id, round_even(abs(l - r), 3) AS delta_cm, 'low' AS severity, 'fmt-' || substr(sha256(doc_id || '|margin-asymmetry'), 1, 24) AS finding_id FROM m WHERE t IS NOT NULL AND abs(l - r) > 0.3""")
def margin_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.table(spark, sf_dir, "supplier")
    rows = s.select(F.concat(F.lit("s"), "s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 7 / 10 + 2).alias("left"), (F.col("s_nationkey") % 5 / 10 + 2).alias("right"), F.when(F.col("s_suppkey") % 11 > 0, 2.5).alias("top"), F.lit(2.5).alias("bottom"))
    return format_check.uneven_margins(rows, FORMAT)


# --- style signals

_COUNT = "(length(t) - length(replace(t, '{p}', ''))) // {n}"


def _hits(phrases: tuple[str, ...]) -> str:
    return " + ".join(_COUNT.format(p=p, n=len(p)) for p in phrases)


def _uniform(values: str, scale: float) -> str:
    return f"CASE WHEN len({values}) >= 3 AND list_sum({values}) > 0 THEN greatest(0.0, least(1.0, 1 - list_stddev_pop({values}) / list_avg({values}) / {scale})) ELSE 0.0 END"


SIGNALS = PARAS + rf""",
st0 AS (SELECT doc_id, sha, paragraph_id, ord, category, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS t FROM judged),
st1 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '[。！？!?；;\n]+'), lambda x: trim(x)), lambda x: length(x) > 0) AS s, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}_]', '', 'g') AS compact FROM st0),
st2 AS (SELECT *, list_transform(s, lambda x: length(x)::DOUBLE) AS lens, list_transform(s, lambda x: (length(x) - length(replace(replace(x, ',', ''), '，', '')))::DOUBLE) AS commas, CASE WHEN length(compact) >= 12 THEN list_transform(range(1, length(compact) - 2), lambda i: substr(compact, i, 4)) END AS g FROM st1),
sg AS (SELECT doc_id, sha, paragraph_id, ord, category, len(s) AS sentences, length(t) AS chars, {_uniform("lens", 0.75)} AS sentence_uniformity, least(1.0, ({_hits(STAND_INS["transitions"])}) / greatest(1.0, len(s) * 0.75)) AS transition_density,
  least(1.0, ({_hits(STAND_INS["generic"])}) / (greatest(1.0, length(t) / 100.0) * 2.0)) AS generic_phrase_density, CASE WHEN g IS NOT NULL THEN least(1.0, (len(g) - len(list_distinct(g))) / len(g) / 0.12) ELSE 0.0 END AS repeated_phrase_ratio,
  CASE WHEN list_sum(commas) > 0 THEN {_uniform("commas", 1.0)} ELSE 0.0 END AS punctuation_uniformity FROM st2),
ps AS (SELECT *, CASE WHEN category = 'standard_response' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS fac FROM sg WHERE coalesce(category, '') NOT IN ('heading', 'short_noise') AND chars >= 80),
aps AS (SELECT *, round_even((sentence_uniformity * 0.30 + transition_density * 0.25 + generic_phrase_density * 0.20 + repeated_phrase_ratio * 0.15 + punctuation_uniformity * 0.10) * fac, 4) AS score, round_even((least(1.0, chars / 400.0) * 0.60 + least(1.0, sentences / 6.0) * 0.40) * fac, 4) AS confidence FROM ps),
ap AS (SELECT *, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'info' END AS severity FROM aps)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir)
    what = interference.category(F.col("text"), F.col("heading_level"), responses=STAND_INS["responses"])
    return stylometry.signals(rows.withColumn("action", interference.action(what)), STAND_INS["transitions"], STAND_INS["generic"])


def _style_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stylometry.paragraph_scores(_signals(spark, sf_dir), STYLE).persist()


@query(f"WITH {SIGNALS} SELECT doc_id, ord, sentences, chars, " + ", ".join(f"round_even({x}, 5) AS {x}" for x in stylometry.SIGNALS) + " FROM sg")
def ai_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("doc_id", "ord", F.col("sentences").cast("long").alias("sentences"), F.col("chars").cast("long").alias("chars"), *[rounded(x, 5).alias(x) for x in stylometry.SIGNALS])


@query(f"WITH {SIGNALS.replace(', 4) AS score', ', 6) AS score').replace(', 4) AS confidence', ', 6) AS confidence')} SELECT doc_id, ord, score, confidence, severity FROM ap")
def ai_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style_scores(spark, sf_dir).select("doc_id", "ord", "score", "confidence", "severity")


AI = SIGNALS.replace(", 4) AS score", ", 6) AS score").replace(", 4) AS confidence", ", 6) AS confidence") + """,
ad AS (SELECT doc_id, count(*) AS eligible_paragraphs, count(*) FILTER (severity <> 'info') AS suspicious_paragraphs, round_even(sum(score * greatest(1.0, chars * confidence)) / sum(greatest(1.0, chars * confidence)), 6) AS ai_likelihood, round_even(sum(confidence * chars) / sum(chars), 6) AS confidence FROM ap GROUP BY doc_id)"""


@query(f"WITH {AI} SELECT * FROM ad")
def ai_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stylometry.document_scores(_style_scores(spark, sf_dir))


@query(f"WITH {AI} SELECT doc_id, paragraph_id, score, confidence, severity, 'ai-' || substr(sha256(sha || '|' || paragraph_id || '|{stylometry.METHOD}'), 1, 24) AS finding_id, true AS non_diagnostic, true AS requires_human_review FROM ap WHERE severity <> 'info' AND confidence >= 0.35")
def ai_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stylometry.findings(_style_scores(spark, sf_dir), STYLE)


@query(fixtures.AI_EXPECTED)
def ai_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicons themselves, on a structured paragraph and on one that is left out."""
    rows = spark.sql(fixtures.AI_PARAGRAPHS)
    s = stylometry.signals(rows)
    return s.select("doc_id", "sentences", *[rounded(x, 4).alias(x) for x in ("transition_density", "generic_phrase_density")])


# --- risk. The format dimension of document d is that of supplier d, its images are those of label d

RISK = STATS + ",\n" + AI[len(PARAS) + 2 :].lstrip() + ",\n" + FORMATS + ",\n" + IMAGE_STATS + """,
idim AS (SELECT doc_id, max(n) AS n, max(rate) AS rate FROM (SELECT left_doc_id AS doc_id, left_images AS n, left_rate AS rate FROM ist UNION ALL SELECT right_doc_id, right_images, right_rate FROM ist) GROUP BY doc_id),
dims AS (SELECT d.doc_id, k.dimension, k.weight, CASE k.dimension WHEN 'text_similarity' THEN t.n > 0 WHEN 'image_similarity' THEN i.n > 0 WHEN 'ai_likelihood' THEN a.doc_id IS NOT NULL WHEN 'format_similarity' THEN f.doc_id IS NOT NULL ELSE false END AS app,
  CASE k.dimension WHEN 'text_similarity' THEN t.rate WHEN 'image_similarity' THEN i.rate WHEN 'ai_likelihood' THEN a.ai_likelihood WHEN 'format_similarity' THEN f.format_risk END AS raw
  FROM docs d CROSS JOIN (VALUES ('text_similarity', 0.40), ('image_similarity', 0.20), ('ai_likelihood', 0.15), ('format_similarity', 0.25)) k(dimension, weight)
  LEFT JOIN (SELECT doc_id, max(eligible_paragraphs) AS n, max(repeated_rate) AS rate FROM stats GROUP BY ALL) t ON t.doc_id = d.doc_id LEFT JOIN idim i ON i.doc_id = d.doc_id LEFT JOIN ad a ON a.doc_id = d.doc_id LEFT JOIN fs f ON f.doc_id = d.doc_id),
dsum AS (SELECT *, coalesce(app, false) AS applicable, sum(CASE WHEN app THEN weight ELSE 0 END) OVER (PARTITION BY doc_id) AS total FROM dims),
rdim AS (SELECT doc_id, dimension, applicable, CASE WHEN applicable THEN round_even(raw, 6) ELSE 0.0 END AS raw_score, weight::DOUBLE AS weight, CASE WHEN applicable THEN round_even(weight::DOUBLE / total::DOUBLE, 6) ELSE 0.0 END AS effective_weight, CASE WHEN applicable THEN round_even(raw * (weight::DOUBLE / total::DOUBLE), 6) ELSE 0.0 END AS contribution FROM dsum),
rdoc AS (SELECT *, CASE WHEN s >= 0.85 THEN 'critical' WHEN s >= 0.65 THEN 'high' WHEN s >= 0.40 THEN 'medium' WHEN s >= 0.20 THEN 'low' ELSE 'minimal' END AS risk_level FROM (SELECT doc_id, round_even(sum(contribution), 6) AS score, round_even(sum(contribution) * 100, 2) AS score_100, round_even(sum(contribution), 9) AS s FROM rdim GROUP BY doc_id)),
rset AS (SELECT batch, count(*) AS documents, 'score-' || substr(sha256(string_agg(sha, '|' ORDER BY sha)), 1, 24) AS score_id, round_even(max(score), 6) AS aggregate_score, round_even(max(score) * 100, 2) AS aggregate_score_100, round_even(sum(CAST(round_even(score * 1e6, 0) AS BIGINT)) / count(*), 0) / 1e6 AS average_score,
  CASE WHEN max(score) >= 0.85 THEN 'critical' WHEN max(score) >= 0.65 THEN 'high' WHEN max(score) >= 0.40 THEN 'medium' WHEN max(score) >= 0.20 THEN 'low' ELSE 'minimal' END AS aggregate_risk_level FROM rdoc JOIN docs USING (doc_id) GROUP BY batch)"""


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = scoring.repeated_dimension("text_similarity", _stats(spark, sf_dir), "doc_id", "repeated_rate", "eligible_paragraphs")
    images = _images(spark, sf_dir).persist()
    pairs = image_compare.image_stats(image_compare.image_pairs_banded(images, IMAGE), images, IMAGE)
    sides = [pairs.select(*[F.col(f"{side}_{c}").alias(c) for c in ("doc_id", "rate", "images")]) for side in ("left", "right")]
    image = scoring.repeated_dimension("image_similarity", sides[0].unionByName(sides[1]), "doc_id", "rate", "images")
    ai = stylometry.document_scores(_style_scores(spark, sf_dir)).select("doc_id", F.lit("ai_likelihood").alias("dimension"), F.lit(True).alias("applicable"), F.col("ai_likelihood").alias("raw_score"))
    fmt = _format_summary(spark, sf_dir).select("doc_id", F.lit("format_similarity").alias("dimension"), F.lit(True).alias("applicable"), F.col("format_risk").alias("raw_score"))
    return scoring.risk_dimensions(tables.documents(spark, sf_dir), [text, image, ai, fmt])


@query(f"WITH {RISK} SELECT * FROM rdim")
def risk_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dimensions(spark, sf_dir)


@query(f"WITH {RISK} SELECT * EXCLUDE (s) FROM rdoc")
def risk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.risk_documents(_dimensions(spark, sf_dir))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.risk_sets(scoring.risk_documents(_dimensions(spark, sf_dir)), tables.documents(spark, sf_dir))


@query(f"WITH {RISK} SELECT * FROM rset")
def risk_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir)


# --- findings of several analyses, reports

MERGED = FINDINGS + ",\n" + AI[len(PARAS) + 2 :].lstrip() + ",\n" + RUNS + ",\n" + PAIRS + f""",
own AS (SELECT doc_id, batch, 'doc-' || substr(sha, 1, 24) AS document_id FROM docs),
mf AS (SELECT batch, finding_id, 'text_similarity' AS type, severity, score, left_document_id AS document_id, right_document_id AS peer_document_id FROM ft
  UNION ALL SELECT a.batch, finding_id, 'image_similarity', 'high', similarity, a.document_id, b.document_id FROM mt JOIN own a ON a.doc_id = left_doc_id JOIN own b ON b.doc_id = right_doc_id
  UNION ALL SELECT batch, 'fmt-' || substr(sha256(doc_id || '|' || para_id || '|body-style-outlier'), 1, 24), 'format_issue', 'low', NULL, document_id, NULL FROM outl JOIN own USING (doc_id)
  UNION ALL SELECT batch, 'fmt-' || substr(sha256(doc_id || '|mixed-body-style'), 1, 24), 'format_issue', 'medium', round_even(1 - dominant_ratio, 6), document_id, NULL FROM dom JOIN own USING (doc_id) WHERE dominant_ratio < 0.7
  UNION ALL SELECT doc_id // 5, 'ai-' || substr(sha256(sha || '|' || paragraph_id || '|{stylometry.METHOD}'), 1, 24), 'ai_likelihood', severity, score, 'doc-' || substr(sha, 1, 24), NULL FROM ap WHERE severity <> 'info' AND confidence >= 0.35),
mm AS (SELECT * FROM mf QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY type DESC, batch, severity, score, document_id, peer_document_id) = 1),
lv AS (SELECT *, list_position(['info', 'low', 'medium', 'high', 'critical'], severity) AS level FROM mm),
rf AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY level DESC, coalesce(score, 0) DESC, finding_id) AS rank FROM lv)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on text, images, format and style; images of label d and runs of supplier d are those of document d."""
    none = F.lit(None).cast("string").alias("peer_document_id")
    text = _findings(spark, sf_dir)[0].select("batch", "finding_id", F.lit("text_similarity").alias("type"), "severity", "score", F.col("left_document_id").alias("document_id"), F.col("right_document_id").alias("peer_document_id"))
    own = tables.documents(spark, sf_dir).select("doc_id", "batch", "document_id")
    matches = image_compare.image_pairs_banded(_images(spark, sf_dir).persist(), IMAGE).drop("batch")
    matches = matches.join(own.withColumnRenamed("doc_id", "left_doc_id"), "left_doc_id").join(own.select(F.col("doc_id").alias("right_doc_id"), F.col("document_id").alias("peer_document_id")), "right_doc_id")
    image = matches.select("batch", "finding_id", F.lit("image_similarity").alias("type"), F.lit("high").alias("severity"), F.col("similarity").alias("score"), "document_id", "peer_document_id")
    signatures = _signatures(spark, sf_dir).persist()
    dominant = format_check.dominant_styles(signatures).persist()
    outliers = format_check.style_outliers(signatures, dominant, FORMAT).select("doc_id", "finding_id", "severity", F.lit(None).cast("double").alias("score"))
    mixed = format_check.mixed_styles(dominant, FORMAT).select("doc_id", "finding_id", "severity", "score")
    fmt = outliers.unionByName(mixed).join(own, "doc_id").select("batch", "finding_id", F.lit("format_issue").alias("type"), "severity", "score", "document_id", none)
    scored = _style_scores(spark, sf_dir)
    ai = stylometry.findings(scored, STYLE).drop("confidence").join(scored.select("doc_id", "paragraph_id", "batch", "document_id"), ["doc_id", "paragraph_id"])
    ai = ai.select("batch", "finding_id", F.lit("ai_likelihood").alias("type"), "severity", "score", "document_id", none)
    return scoring.merged([text, image, fmt, ai])


@query(f"WITH {MERGED} SELECT batch, finding_id, type, severity, score, document_id, peer_document_id FROM mm")
def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query(f"WITH {MERGED}, e AS (SELECT finding_id, document_id FROM mm UNION SELECT finding_id, peer_document_id FROM mm WHERE peer_document_id IS NOT NULL) SELECT document_id, list_sort(list(finding_id)) AS finding_ids FROM e GROUP BY document_id")
def related_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.related_findings(_merged(spark, sf_dir))


@query(f"WITH {MERGED} SELECT batch, rank, finding_id, type, severity, document_id, peer_document_id FROM rf WHERE rank <= 20")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_findings(_merged(spark, sf_dir))


def _literal(pairs: dict[str, str], value: str, other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE '{other}' END"


@query(f"""WITH {MERGED}, g AS (SELECT batch, type, max(level) AS level, min(rank) AS first, list(finding_id ORDER BY rank)[1:5] AS related_finding_ids FROM rf GROUP BY batch, type)
SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY level DESC, first) AS position, CASE WHEN level >= 5 THEN 'immediate' WHEN level >= 4 THEN 'high' ELSE 'normal' END AS priority, {_literal(report.ACTIONS, "type", report.OTHER_ACTION)} AS action, related_finding_ids FROM g
UNION ALL SELECT DISTINCT batch, 1, 'normal', '{report.DEFAULT_ACTION}', []::VARCHAR[] FROM docs WHERE batch NOT IN (SELECT batch FROM mm)""")
def report_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_actions(_merged(spark, sf_dir).persist(), tables.documents(spark, sf_dir))


@query(f"""WITH {RISK}, own AS ({MERGED.split("own AS (", 1)[1]},
best AS (SELECT batch, doc_id FROM rdoc JOIN docs USING (doc_id) QUALIFY row_number() OVER (PARTITION BY batch ORDER BY score DESC, 'doc-' || substr(sha, 1, 24) DESC, doc_id DESC) = 1),
tp AS (SELECT batch, list({_literal(report.DIMENSION_LABELS, "dimension", "")} ORDER BY contribution DESC, list_position(['text_similarity', 'image_similarity', 'ai_likelihood', 'format_similarity'], dimension))[1:2] AS top FROM best JOIN rdim USING (doc_id) WHERE applicable GROUP BY batch),
ur AS (SELECT batch, count(*) FILTER (severity IN ('high', 'critical')) AS urgent, '["' || string_agg(finding_id, '","' ORDER BY finding_id) || '"]' AS ids FROM mm GROUP BY batch)
SELECT r.batch, 'report-' || substr(sha256('{{"finding_ids":' || coalesce(ids, '[]') || ',"method":"{report.METHOD}","score_id":"' || score_id || '"}}'), 1, 24) AS report_id, aggregate_risk_level,
  '本次分析 ' || documents || ' 份文件，总体风险等级为' || {_literal(report.RISK_LABELS, "aggregate_risk_level", "")} || '（' || printf('%.2f', aggregate_score_100) || '/100）。主要风险维度为' || coalesce(array_to_string(top, '、'), '暂无适用风险维度') || '。共有 ' || coalesce(urgent, 0) || ' 项高等级问题需要优先人工复核。' AS summary
FROM rset r LEFT JOIN tp USING (batch) LEFT JOIN ur USING (batch)""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    dimensions = _dimensions(spark, sf_dir).persist()
    scores = scoring.risk_documents(dimensions)
    named = scores.join(docs.select("doc_id", "batch", "document_id"), "doc_id")
    return report.report_summary(scoring.risk_sets(scores, docs), named, dimensions, _merged(spark, sf_dir))


# --- a complete analysis: each text becomes a Word file, which is parsed and goes through every step to a report

# a paragraph of a length divisible by 10 has a larger font, that of every seventh document another margin
FILES = STATS + ",\n" + AI[len(PARAS) + 2 :].lstrip() + """,
sig AS (SELECT doc_id, ord AS para_id, 'Serif' AS font, CASE WHEN length(text) % 10 = 0 THEN 14.0::DOUBLE ELSE 12.0::DOUBLE END AS size FROM judged WHERE heading_level IS NULL),
dc AS (SELECT doc_id, font, size, count(*) AS n, min(para_id) AS f FROM sig GROUP BY ALL),
dom AS (SELECT d.doc_id, d.size AS dominant_size, t.comparable, round_even(d.n / t.comparable, 6) AS dominant_ratio FROM (SELECT * FROM dc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1) d JOIN (SELECT doc_id, count(*) AS comparable FROM sig GROUP BY ALL) t USING (doc_id)),
outl AS (SELECT s.doc_id, s.para_id FROM sig s JOIN dom USING (doc_id) WHERE abs(s.size - dominant_size) > 0.5),
mar AS (SELECT doc_id FROM docs WHERE doc_id % 7 = 0),
fs AS (SELECT coalesce(d.doc_id, m.doc_id) AS doc_id, greatest(round_even(greatest(coalesce(o.n, 0) / comparable, CASE WHEN dominant_ratio < 0.7 THEN greatest(round_even(1 - dominant_ratio, 6), 0.55) ELSE 0 END, CASE WHEN o.n > 0 THEN 0.25 ELSE 0 END), 6), CASE WHEN m.doc_id IS NOT NULL THEN 0.25 ELSE 0 END) AS format_risk
  FROM dom d LEFT JOIN (SELECT doc_id, count(*) AS n FROM outl GROUP BY ALL) o USING (doc_id) FULL JOIN mar m ON m.doc_id = d.doc_id),
ist AS (SELECT 0 AS left_doc_id, 0 AS right_doc_id, 0 AS left_images, 0 AS right_images, 0.0 AS left_rate, 0.0 AS right_rate WHERE false),
""" + RISK[RISK.index("idim AS (") :] + f""",
own AS (SELECT doc_id, batch, 'doc-' || substr(sha, 1, 24) AS document_id FROM docs),
mf AS (SELECT batch, 'text_similarity' AS type, severity, score FROM ft
  UNION ALL SELECT batch, 'format_issue', 'low', NULL FROM outl JOIN own USING (doc_id) UNION ALL SELECT batch, 'format_issue', 'medium', round_even(1 - dominant_ratio, 6) FROM dom JOIN own USING (doc_id) WHERE dominant_ratio < 0.7 UNION ALL SELECT batch, 'format_issue', 'low', NULL FROM mar JOIN own USING (doc_id)
  UNION ALL SELECT doc_id // 5, 'ai_likelihood', severity, score FROM ap WHERE severity <> 'info' AND confidence >= 0.35),
ur AS (SELECT batch, count(*) AS findings, count(*) FILTER (severity IN ('high', 'critical')) AS urgent, count(*) FILTER (type = 'format_issue') AS format_findings FROM mf GROUP BY batch)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files made of the texts, as read from storage: path and content."""
    from ..sources import docx

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                lines = [(x, docx.clean(x)) for x in text.split("\n")]
                rows = [{"text": x, "heading_level": 1 + len(c) % 3 if 0 < len(c) < 40 else None, "font": "Serif", "size": 14 if len(c) % 10 == 0 else 12} for x, c in lines]
                out.append((f"{doc_id}.docx", docx.build(rows, {"top": 2.54, "bottom": 2.54, "left": 3.81 if doc_id % 7 == 0 else 2.54, "right": 2.54}, {"title": str(doc_id)})))
            yield pd.DataFrame(out, columns=["path", "content"])

    rows = tables.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return tables.dealt(rows, "doc_id").mapInPandas(run, "path string, content binary")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import dispatch

    parsed = dispatch.parse_files(_files(spark, sf_dir)).where("error IS NULL").withColumn("doc_id", F.regexp_extract("path", "(\\d+)\\.docx$", 1).cast("long"))
    return parsed.withColumn("batch", F.floor(F.col("doc_id") / tables.BATCH).cast("long"))


@query(f"WITH {PARAS} SELECT d.doc_id, d.doc_id || '.docx' AS filename, 'docx' AS file_type, CAST(NULL AS INTEGER) AS page_count, count(m.ord) AS paragraph_count, 0::BIGINT AS table_count, 0::BIGINT AS image_count, 0::BIGINT AS warning_count FROM docs d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id")
def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import analysis

    return analysis.profiles(_parsed(spark, sf_dir)).drop("size_bytes")


@query(f"""WITH {FILES} SELECT r.batch, r.documents, aggregate_score, aggregate_risk_level, average_score, coalesce(findings, 0) AS findings, coalesce(urgent, 0) AS urgent, coalesce(format_findings, 0) AS format_findings, list_sort(list(f.risk_level)) AS levels
FROM rset r JOIN docs d USING (batch) JOIN rdoc f USING (doc_id) LEFT JOIN ur u ON u.batch = r.batch GROUP BY ALL""")
def complete_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the files' bytes to each batch's scores, findings and levels."""
    from . import analysis

    parsed = _parsed(spark, sf_dir).drop("images", "tables").persist()
    done = analysis.complete(parsed, TEXT, FORMAT, STYLE, sequence=False, lexicons=STAND_INS)
    counts = done.findings.groupBy("batch").agg(F.count("*").alias("findings"), F.count_if(F.col("severity").isin("high", "critical")).alias("urgent"), F.count_if(F.col("type") == "format_issue").alias("format_findings"))
    levels = done.documents.join(parsed.select("doc_id", "batch"), "doc_id").groupBy("batch").agg(F.sort_array(F.collect_list("risk_level")).alias("levels"))
    zero = F.lit(0).cast("long")
    return done.sets.join(levels, "batch").join(counts, "batch", "left").select("batch", "documents", "aggregate_score", "aggregate_risk_level", "average_score", *[F.coalesce(c, zero).alias(c) for c in ("findings", "urgent", "format_findings")], "levels")


# --- signatures, seals, identity and dates: inline evidence of six documents


def _compliance(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ..sources import evidence

    rules = evidence.rules(spark.createDataFrame([(d, fixtures.RULES % pages) for d, (pages, _) in fixtures.EVIDENCE.items()], "document_id string, payload string")).where("error IS NULL")
    native = spark.createDataFrame([], "document_id string, page_number int, ord int, text string")
    pages = evidence.pages(native, spark.createDataFrame([(d, p) for d, (_, p) in fixtures.EVIDENCE.items()], "document_id string, payload string"))
    return rules, pages, evidence.candidates(pages)


def _evaluated(spark: SparkSession) -> DataFrame:
    from ..operators import compliance

    return compliance.evaluated(*_compliance(spark))


@query(fixtures.SIG_FINDINGS)
def sig_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import compliance

    return compliance.findings(_evaluated(spark)).select("document_id", "issue_code", "severity", "score")


@query(fixtures.SIG_RULES)
def sig_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import compliance

    return compliance.rule_status(_evaluated(spark)).select("document_id", "status", "finding_count", "matched_company_name", "matched_signer_name", "matched_date")


@query("SELECT user_id AS document_id, event_id AS candidate_id, kind, confidence, row_number() OVER (PARTITION BY user_id, kind ORDER BY confidence DESC, event_id) AS rank FROM (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'signature' ELSE 'seal' END AS kind, round_even(least(1.0, abs(value) / 100), 6) AS confidence FROM events)")
def sig_candidates_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import compliance

    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.lit(1).alias("page_number"), F.col("event_id").alias("candidate_id"), F.when(F.col("event_type") == "click", "signature").otherwise("seal").alias("kind"), rounded(F.least(F.lit(1.0), F.abs("value") / 100), 6).alias("confidence"))
    return compliance.ranked_candidates(rows).drop("page_number")


@query(fixtures.OCR_EXPECTED)
def ocr_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import evidence

    rows = spark.sql(fixtures.OCR).select("page_number", "status", F.from_json("items", f"array<{evidence.ITEM}>").alias("items"))
    return evidence.ocr_checked(rows).select("page_number", "evidence_id", "error", "review")


# --- tasks and audit events: a user is a task, an event is an event

STEPS = """steps AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_type, props, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' END AS status FROM events)"""
CHAIN = STEPS + """,
ev AS (SELECT task_id, sequence, '{"actor_id":"user-' || task_id || '","created_at":"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '","event_type":"' || event_type || '","payload_json":' || to_json(props) || ',"previous_event_hash":"' AS head, '","sequence":' || sequence || ',"stage":null,"task_id":"' || task_id || '"}' AS tail FROM steps),
fo AS (SELECT task_id, list(head ORDER BY sequence) AS h, list(tail ORDER BY sequence) AS t FROM ev GROUP BY task_id),
hs AS (SELECT task_id, list_reduce(list_prepend([repeat('0', 64)], list_transform(range(1, len(h) + 1), lambda i: [h[i], t[i]])), lambda acc, e: list_append(acc, sha256(e[1] || acc[len(acc)] || e[2]))) AS c FROM fo),
ch AS (SELECT task_id, unnest(range(1, len(c))) AS sequence, unnest(c[1:len(c) - 1]) AS previous_event_hash, unnest(c[2:]) AS event_hash FROM hs)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = tables.table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select(F.col("user_id").alias("task_id"), F.row_number().over(order).cast("long").alias("sequence"), "event_type", "props", "ts", audit.status_of(F.col("event_type")).alias("status"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _steps(spark, sf_dir).select(F.col("task_id").cast("string").alias("task_id"), "sequence", "event_type", F.lit(None).cast("string").alias("stage"), F.concat(F.lit("user-"), "task_id").alias("actor_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), F.col("props").alias("payload_json"))
    return audit.chained(rows)


@query(f"WITH {CHAIN} SELECT CAST(task_id AS VARCHAR) AS task_id, sequence, previous_event_hash, event_hash FROM ch")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).select("task_id", "sequence", "previous_event_hash", "event_hash")


@query(f"WITH {STEPS} SELECT CAST(task_id AS VARCHAR) AS task_id, count(*) AS events, true AS valid, CAST(NULL AS BIGINT) AS first_bad FROM steps GROUP BY task_id")
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.verified(_chain(spark, sf_dir))


@query(f"WITH {STEPS} SELECT CAST(task_id AS VARCHAR) AS task_id, count(*) AS events, count(*) < 2 AS valid, CASE WHEN count(*) >= 2 THEN 2 END AS first_bad FROM steps GROUP BY task_id")
def audit_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second event of every task has another payload than was signed."""
    chain = _chain(spark, sf_dir)
    return audit.verified(chain.withColumn("payload_json", F.when(F.col("sequence") == 2, F.lit('{"edited":true}')).otherwise(F.col("payload_json"))))


MOVES = STEPS + """, mv AS (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY sequence) AS from_status FROM steps),
st AS (SELECT task_id, arg_max(status, sequence) AS status, count(*) FILTER (status = 'running' AND from_status IS DISTINCT FROM 'running') AS attempt_count, max(sequence) AS last_sequence FROM mv GROUP BY task_id)"""


@query(f"WITH {MOVES} SELECT * FROM st")
def task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.state(_steps(spark, sf_dir).select("task_id", "sequence", "status"))


@query(f"""WITH {MOVES} SELECT task_id, sequence, from_status, status FROM mv WHERE NOT coalesce(CASE WHEN from_status IS NULL THEN status = 'created' WHEN from_status = 'created' THEN status IN ('running', 'cancelled')
  WHEN from_status = 'running' THEN status IN ('running', 'succeeded', 'failed', 'interrupted', 'cancelled') WHEN from_status IN ('failed', 'interrupted') THEN status IN ('running', 'cancelled') ELSE false END, false)""")
def task_transitions_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.transitions(_steps(spark, sf_dir).select("task_id", "sequence", "status")).where("NOT allowed").select("task_id", "sequence", "from_status", "status")


@query(f"WITH {MOVES} SELECT task_id, 'interrupted' AS status, attempt_count, last_sequence + 1 AS sequence, 'task_interrupted' AS event_type FROM st WHERE status = 'running'")
def task_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.recovered(audit.state(_steps(spark, sf_dir).select("task_id", "sequence", "status")))


@query("WITH g AS (SELECT o_custkey AS task_id, count(*) AS requests, count(DISTINCT o_orderstatus || '|' || o_orderpriority) AS kinds FROM orders GROUP BY o_custkey) SELECT task_id, requests, CASE WHEN kinds > 1 THEN 'conflict' WHEN requests > 1 THEN 'existing' ELSE 'created' END AS outcome FROM g")
def task_created_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.created_once(tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("fingerprint"), F.col("o_orderpriority").alias("context")))


@query(f"WITH {MOVES} SELECT * FROM st")
def task_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from a stream over the steps."""
    from ..streaming import task_stream

    return task_stream.states_of_table(_steps(spark, sf_dir).select("task_id", "sequence", "status"))


@query("SELECT window_start, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, user_id FROM events) GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events by the hour."""
    return tables.table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").alias("window_start"), "event_type", "events", "users")


@query(f"WITH {MOVES}, c AS (SELECT user_id AS task_id, min(ts) AS created_at FROM events GROUP BY ALL) SELECT st.*, created_at, row_number() OVER (PARTITION BY status ORDER BY created_at, task_id) AS place FROM st JOIN c USING (task_id) WHERE status IN ('running', 'failed')")
def tasks_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    return audit.by_status(audit.state(steps.select("task_id", "sequence", "status")), steps.select("task_id", F.col("ts").alias("created_at")), ("running", "failed"))


@query("SELECT user_id AS task_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def repeated_event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and kinds of events as keys that are not unique."""
    return audit.repeated_keys(tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "event_type"), ["task_id", "event_type"])


# --- requests: a batch of texts is a request's files, a url is an uploaded name, a customer a key


@query(f"""WITH {DOCS}, f AS (SELECT batch, doc_id, '{{"file_type":"txt","filename":"' || doc_id || '.txt","sha256":"' || sha || '","size_bytes":' || strlen(text) || '}}' AS r FROM docs)
SELECT batch, CAST(count(*) AS INTEGER) AS n_files, sha256('{{"api_version":"{requests.VERSION}","files":[' || string_agg(r, ',' ORDER BY doc_id) || ']}}') AS request_fingerprint FROM f GROUP BY batch""")
def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    files = docs.select("batch", F.col("doc_id").alias("ord"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit("txt").alias("file_type"), F.col("file_size_bytes").alias("size_bytes"), "sha256")
    return requests.fingerprints(files, ["batch"])


@query(r"SELECT page_id, nullif(nullif(nullif(trim(regexp_extract(regexp_replace(coalesce(url, ''), '(/\.?)+$', ''), '[^/]*$')), ''), '.'), '..') AS filename FROM pages")
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", requests.safe_filename(F.col("url")).alias("filename"))


@query("SELECT c_custkey, 'api-key:' || substr(sha256(c_name), 1, 16) AS actor_id FROM customer")
def actor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "customer").select("c_custkey", requests.actor_id(F.col("c_name")).alias("actor_id"))


# --- versions: texts 2k and 2k + 1 are two versions of a document


@query()
def sequence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paragraphs(spark, sf_dir).select(F.floor(F.col("doc_id") / 2).cast("string").alias("pair_id"), (F.col("doc_id") % 2).cast("int").alias("side"), "ord", comparable(F.col("text")).alias("text")).where("length(text) > 0")
    return diff.sequence_diff(rows)


@query("""WITH c AS (SELECT CAST(o_custkey // 2 AS VARCHAR) AS pair_id, CAST(o_custkey % 2 AS INTEGER) AS side, o_orderstatus AS table_ord, list([o_orderpriority, CAST(o_orderkey AS VARCHAR)] ORDER BY o_orderkey) AS cells FROM orders GROUP BY ALL),
b AS (SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, l.cells AS x, r.cells AS y FROM (SELECT * FROM c WHERE side = 0) l FULL JOIN (SELECT * FROM c WHERE side = 1) r ON l.pair_id = r.pair_id AND l.table_ord = r.table_ord)
SELECT pair_id, count(x) AS left_tables, count(y) AS right_tables, count(*) FILTER (x = y) AS equal_tables, count(*) FILTER (x IS DISTINCT FROM y) AS changed_tables FROM b GROUP BY pair_id""")
def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    return diff.table_diff(o.select(F.floor(F.col("o_custkey") / 2).cast("string").alias("pair_id"), (F.col("o_custkey") % 2).cast("int").alias("side"), F.col("o_orderstatus").alias("table_ord"), F.col("o_orderkey").alias("row"), F.col("o_orderkey").cast("string").alias("cell"), F.col("o_orderpriority").alias("text")))


@query("""WITH p AS (SELECT p_brand AS pair_id, CAST(p_partkey % 2 AS INTEGER) AS side, p_type AS name, sha256(CAST(count(*) AS VARCHAR)) AS sha FROM part GROUP BY ALL)
SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, coalesce(l.name, r.name) AS name, CASE WHEN r.sha IS NULL THEN 'only_left' WHEN l.sha IS NULL THEN 'only_right' WHEN l.sha = r.sha THEN 'same' ELSE 'changed' END AS status FROM (SELECT * FROM p WHERE side = 0) l FULL JOIN (SELECT * FROM p WHERE side = 1) r ON l.pair_id = r.pair_id AND l.name = r.name""")
def package_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("pair_id"), (F.col("p_partkey") % 2).cast("int").alias("side"), F.col("p_type").alias("name")).agg(F.sha2(F.count("*").cast("string"), 256).alias("sha256"))
    return diff.package_diff(p)


@query(f"""WITH {IMAGES}, o AS (SELECT *, CAST(doc_id // 2 AS VARCHAR) AS pair_id, doc_id % 2 AS side, row_number() OVER (PARTITION BY doc_id ORDER BY image_id) AS ord FROM img),
b AS (SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, l.sha256 AS a, r.sha256 AS b, l.h AS ph, r.h AS qh, l.width AS lw, l.height AS lh, r.width AS rw, r.height AS rh FROM (SELECT * FROM o WHERE side = 0) l FULL JOIN (SELECT * FROM o WHERE side = 1) r ON l.pair_id = r.pair_id AND l.ord = r.ord)
SELECT pair_id, count(a) AS left_images, count(b) AS right_images, count(*) FILTER (a = b) AS binary_equal, count(*) FILTER (ph = qh) AS perceptual_equal, count(*) FILTER (lw = rw AND lh = rh) AS size_equal FROM b GROUP BY pair_id""")
def image_order_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _images(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("image_id")))
    return diff.image_order_diff(rows.select(F.floor(F.col("doc_id") / 2).cast("string").alias("pair_id"), (F.col("doc_id") % 2).alias("side"), "ord", "sha256", "phash", "width", "height"))


@query("SELECT count(*) AS inputs, true AS unchanged FROM documents WHERE text IS NOT NULL")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "sha256")
    return diff.unchanged(docs, tables.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "sha256"))


@query(f"""WITH {FINDINGS}, ref AS (SELECT DISTINCT unnest(list_distinct(list_transform(range(1, length(n) - 8), lambda i: substr(n, i, 10)))) AS g FROM (SELECT lower(regexp_replace(text, '[^一-鿿A-Za-z0-9]+', '', 'g')) AS n FROM benchmark) WHERE length(n) >= 10),
own AS (SELECT DISTINCT doc_id, ord, g FROM (SELECT doc_id, ord, unnest(list_transform(range(1, length(norm) - 8), lambda i: substr(norm, i, 10))) AS g FROM elig WHERE length(norm) >= 10)),
ov AS (SELECT doc_id, ord FROM own JOIN ref USING (g) GROUP BY ALL HAVING count(*) >= 20),
attr AS (SELECT f.batch, a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AS known FROM ft f LEFT JOIN ov a ON a.doc_id = left_doc AND a.ord = left_ord LEFT JOIN ov b ON b.doc_id = right_doc AND b.ord = right_ord WHERE severity = 'high')
SELECT batch, count(*) AS high_pairs, count(*) FILTER (known) AS attributed_pairs, round_even(count(*) FILTER (known) / count(*), 6) AS attributed_ratio FROM attr GROUP BY batch""")
def reference_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High pairs both of whose paragraphs have at least 20 ten-character grams of the benchmark, the reference document."""
    found, prepared = _findings(spark, sf_dir)
    grams = lambda df, *keys: df.select(*keys, F.explode(F.array_distinct(ngrams(F.col("normalized"), 10, 10))).alias("g"))
    reference = grams(tables.table(spark, sf_dir, "benchmark").select(comparable(F.col("text")).alias("normalized"))).distinct()
    overlaps = grams(prepared, "doc_id", "ord").join(reference, "g").groupBy("doc_id", "ord").count().where("count >= 20")
    return diff.attributed(found.where("severity = 'high'").select("batch", "left_doc", "left_ord", "right_doc", "right_ord"), overlaps)


@query(f"""WITH {STATS}, sm AS (SELECT p.batch, p.left_doc, p.right_doc, coalesce(max(score), 0.0) AS top FROM docpairs p LEFT JOIN ft f ON f.left_doc = p.left_doc AND f.right_doc = p.right_doc GROUP BY ALL),
r AS (SELECT left_doc, right_doc, min(repeated_rate) AS rate FROM stats GROUP BY ALL)
SELECT batch, left_doc, right_doc, rate AS repeated_rate, rate >= 0.5 AS rate_ok, top >= 0.85 AS similarity_ok, rate >= 0.5 AND top >= 0.85 AS passed FROM sm JOIN r USING (left_doc, right_doc)""")
def expectation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, prepared = _findings(spark, sf_dir)
    pairs = text_compare.document_pairs(prepared, tables.documents(spark, sf_dir))
    keys = ["batch", "left_doc", "right_doc"]
    stats = text_compare.document_stats(found, prepared, pairs)
    rates = [stats.where(F.col("side") == s).select(*keys, F.col("repeated_rate").alias(f"{s}_rate")) for s in ("left", "right")]
    return diff.expectations(text_compare.pair_summary(found, pairs).join(rates[0], keys).join(rates[1], keys), 0.5, 0.85)


# --- annotation


def _plan(spark: SparkSession) -> DataFrame:
    place = F.struct(F.col("p").alias("paragraph_index"), F.col("t").alias("table_index"), F.col("r").alias("row_index"), F.col("c").alias("cell_index"))
    found = spark.sql(fixtures.FINDINGS).withColumn("locator", place).withColumn("peer_locator", place).drop("p", "t", "r", "c")
    targets = spark.createDataFrame([("target",)], "target string")
    shapes = spark.createDataFrame([("target", 2, 1)], "target string, paragraphs int, tables int")
    cells = spark.createDataFrame([("target", 0, 0, 1)], "target string, table_index int, row_index int, cells int")
    return annotate.plan(found, targets, shapes, cells, Annotation())


@query(fixtures.PLAN_EXPECTED)
def annotation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark).select("finding_id", "role", "skip_reason")


@query(fixtures.SKIPS_EXPECTED)
def annotation_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.skip_reasons(_plan(spark))


@query()
def seal_and_ink_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates on generated pages: a red ring and a handwritten line, by supplier."""
    import numpy as np

    from ..functions import pixels

    def run(batches):
        import pandas as pd

        rows, cols = np.ogrid[:200, :300]
        for batch in batches:
            out = []
            for key in batch["s_suppkey"]:
                page = np.full((200, 300, 3), 255, np.uint8)
                ring = np.hypot(rows - 60, cols - 70 - key % 50)
                page[(ring < 32) & (ring > 22)] = (200, 20, 30)
                page[150:154, 40 : 160 + key % 40] = 20
                found = pixels.detect(page, (20, 130, 240, 50))
                out += [(key, c["kind"], c["colour"], [float(x) for x in c["bbox"]], c["confidence"], c["quality_flags"]) for c in found["candidates"]]
            yield pd.DataFrame(out, columns=["page_id", "kind", "colour", "bbox", "confidence", "quality_flags"])

    # few bytes and much work for each: one small file would be one task
    suppliers = tables.table(spark, sf_dir, "supplier").select("s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return suppliers.mapInPandas(run, "page_id long, kind string, colour string, bbox array<double>, confidence double, quality_flags array<string>")
