"""Passages that say little about copying: headings, short noise and standard responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id

#: Patterns of standard tender responses.
RESPONSES = (
    r"招标文件第\s*[一二三四五六七八九十百千万0-9]+\s*条",
    "我方承诺",
    "我方完全响应",
    "完全满足招标要求",
    "法定代表人身份证明",
    "授权委托书",
    "投标函",
    "资格声明",
)
MIN_CHARS = 8


def category(text: Column, heading_level: Column, responses: tuple[str, ...] = RESPONSES, min_chars: int = MIN_CHARS) -> Column:
    """The first that holds of heading, short_noise and standard_response; null otherwise."""
    pattern = "(?i)" + "|".join(f"(?:{r})" for r in responses)
    return F.when(heading_level.isNotNull(), "heading").when(F.length(F.trim(text)) < min_chars, "short_noise").when(text.rlike(pattern), "standard_response")


def action(of: Column) -> Column:
    return F.when(of.isin("heading", "short_noise"), "exclude").when(of == "standard_response", "downweight")


def items(paragraphs: DataFrame, **settings) -> DataFrame:
    """One row per passage found, with the id of its finding."""
    found = paragraphs.withColumn("category", category(F.col("text"), F.col("heading_level"), **settings)).where("category IS NOT NULL")
    return found.select("doc_id", "document_id", "paragraph_id", "category", action(F.col("category")).alias("action"), stable_id("int-", F.col("sha256"), F.col("paragraph_id"), F.col("category")).alias("finding_id"))


def summary(paragraphs: DataFrame, **settings) -> DataFrame:
    """Counts per document: paragraphs, items, those to exclude and those to weigh less."""
    what = action(category(F.col("text"), F.col("heading_level"), **settings))
    return paragraphs.withColumn("action", what).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count("action").alias("items"), F.count_if(F.col("action") == "exclude").alias("excluded"), F.count_if(F.col("action") == "downweight").alias("downweighted"))
