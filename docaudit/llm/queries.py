"""The ten queries and the pipeline over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_text, line_dedup, media, ngram_join, packing, quality, secret_scan, token_store, tokens, warc
from .common import new_folder, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a classifier learned from labels outside fold 0."""
    documents = table(spark, sf_dir, "documents")
    scores = quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back: one row per page with its whole payload's length and digest."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "warc"), least_bytes=0)
    return warc.read_chunks(spark, manifest, with_payload=False).where("last").selectExpr("page_id", "total_bytes AS payload_bytes", "digest_so_far AS payload_digest", "record_type", "refers_to")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of a Jaccard similarity of 0.75 or more."""
    return ngram_join.near_documents(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    files = token_store.write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), tokens.vocabulary("word_bpe_49k.json"), end_id=2)
    return token_store.read_token_files(spark, files)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as images in tar shards, read back."""
    return media.media_rows(table(spark, sf_dir, "documents"), new_folder(spark, "media"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold an item of the benchmark, with the item and the figures found."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go from each of all documents."""
    return line_dedup.removals(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_warc_records, op3_ngram_join, op4_secrets, op5_main_text, op6_token_file, op7_pack, op8_media_columns, op9_decontamination, op10_line_dedup)}

ORACLES = {
    "op2_warc_records": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT x, max(page_id) AS latest FROM p GROUP BY x),
b AS (SELECT page_id, strlen(h) AS n, x, latest, list_transform(range(8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::BIGINT) AS v FROM p JOIN g USING (x))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v[(i // 4) + 1] >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM b""",
    # all pairs that share a shingle; the smallest document that is reachable by links
    "op3_ngram_join": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id""",
}
