"""A semantic score beside the lexical one: cosine of embeddings that are joined by paragraph id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


def reranked(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """pairs(left_id, right_id, lexical) with the semantic score in [0, 1]; the greater of both counts."""
    left, right = (embeddings.select(F.col("vec_id").alias(f"{s}_id"), F.col("embedding").alias(f"{s}_e")) for s in ("left", "right"))
    semantic = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("left_e"), F.col("right_e"))))
    rows = pairs.join(left, "left_id").join(right, "right_id").withColumn("semantic_score", rounded(semantic, 5))
    return rows.select("left_id", "right_id", "lexical", "semantic_score", F.greatest("lexical", "semantic_score").alias("raw_score"))
