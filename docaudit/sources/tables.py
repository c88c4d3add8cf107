"""Driver tables as documents and paragraphs: a line of a text is a paragraph, five doc_ids in a row are a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized

BATCH = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out over the tasks by a key: a small file is one task, however much work its rows are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text: its digest, its content-derived id and its batch."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    sha = F.sha2(F.col("text"), 256)
    return rows.select("doc_id", F.floor(F.col("doc_id") / BATCH).cast("long").alias("batch"), sha.alias("sha256"), F.concat(F.lit("doc-"), F.substring(sha, 1, 24)).alias("document_id"), F.octet_length("text").cast("long").alias("file_size_bytes"), "text")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs that are not empty, numbered as kept (ord from 0), with their raw place in the text."""
    raw = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("raw_index"), normalized(x).alias("text")))
    kept = F.filter(raw, lambda p: F.length(p["text"]) > 0)
    exploded = docs.select("doc_id", "batch", "sha256", "document_id", F.posexplode(kept).alias("ord", "p"))
    return exploded.select("doc_id", "batch", "sha256", "document_id", "ord", F.format_string("p-%06d", F.col("ord") + 1).alias("paragraph_id"), F.col("p.raw_index").alias("raw_index"), F.col("p.text").alias("text"))
