"""A corpus pipeline: quality, lines, near documents, benchmark leaks, packing. Part of the subpackage docaudit.llm.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; run() writes each stage's result as Parquet
and reads it again.

Defined results: a null text counts as empty; quality and leaks are decided for each text, also where rows share a doc_id or
have none; near documents are decided by doc_id, and rows without one stay; repeated rows have one fate; empty tables give no
rows; further columns of documents are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import common, decontam, line_dedup, ngram_join, packing, quality, tokens

#: Documents of a lower score go.
LEAST_QUALITY = 0.3


def _keyed(docs: DataFrame) -> DataFrame:
    """docs by a key of doc_id and text, which tells rows of one doc_id apart."""
    return docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs whose key is not among the doc_ids of keys."""
    gone = keys.select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", F.xxhash64("doc_id", "text")).join(gone, "_key", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of docs outside fold 0, does not reject."""
    weights = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return _without(docs, common.written(quality.score(_keyed(docs), weights).where(F.col("score") < LEAST_QUALITY), "rejected"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a near line elsewhere stands for; those left with nothing go."""
    kept = line_dedup.deduplicated(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of near documents."""
    components = common.written(ngram_join.near_documents(docs), "components")
    gone = components.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return _without(docs, common.written(decontam.contaminated(_keyed(docs), common.table(spark, sf_dir, "benchmark")), "leaks"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 1024 ids."""
    return packing.pack_documents(docs, tokens.vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The learned scores cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
