"""Explainable writing-style signals. They are not a diagnosis: every result needs a person's review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Style
from ..functions.text import bound, clamped, ngrams, occurrences, stable_id, rounded

METHOD = "stylometry-heuristic-alpha-v1"
#: Phrases that link sentences, and phrases of general praise.
TRANSITIONS = ("首先", "其次", "再次", "此外", "同时", "最后", "综上", "一方面", "另一方面", "总而言之", "值得注意的是")
GENERIC = ("全面提升", "有效提升", "全面保障", "持续优化", "显著提高", "确保项目", "通过统一", "实现协同", "形成闭环", "赋能业务", "提高效率", "降低风险")
SIGNALS = ("sentence_uniformity", "transition_density", "generic_phrase_density", "repeated_phrase_ratio", "punctuation_uniformity")


def _uniformity(values: Column, scale: float) -> Column:
    """1 less the coefficient of variation in units of scale; 0 for fewer than three values or a mean of 0."""
    def of(v: Column) -> Column:
        n = F.size(v)
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        deviation = bound(total / n, lambda mean: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n) / mean)
        return F.when((n >= 3) & (total > 0), clamped(1.0 - deviation / scale)).otherwise(0.0)

    return bound(values, of)


def _fours(text: Column) -> Column:
    """Character 4-grams; a look-ahead finds one at each place, but takes halves of characters beyond the basic plane."""
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), ngrams(text, 4, 4)).otherwise(F.regexp_extract_all(text, F.lit("(?s)(?=(.{4}))"), F.lit(1)))


def signals(paragraphs: DataFrame, transitions: tuple[str, ...] = TRANSITIONS, generic: tuple[str, ...] = GENERIC) -> DataFrame:
    """paragraphs(text) with the five signals, the number of sentences and of characters.

    Each intermediate is a column read more than once, which the optimizer does not compute again for every reader.
    """
    # most texts have single spaces alone, and looking is cheaper than replacing each
    odd = F.col("text").rlike(r"(?U)^[\s\x1c-\x1f]|[\s\x1c-\x1f]$|[\s\x1c-\x1f]{2}|(?! )[\s\x1c-\x1f]")
    plain = F.regexp_replace(F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), r"(?U)[\s\x1c-\x1f]+", " ")
    rows = paragraphs.withColumn("_t", F.when(odd, plain).otherwise(F.col("text")))
    rows = rows.withColumn("_s", F.filter(F.transform(F.split("_t", "[。！？!?；;\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 0))
    rows = rows.withColumns({"sentences": F.size("_s"), "chars": F.length("_t"), "_c": F.regexp_replace(F.lower("_t"), r"(?U)[^\w一-鿿]", "")})
    rows = rows.withColumns({
        "_lengths": F.transform("_s", lambda x: F.length(x).cast("double")),
        "_commas": F.transform("_s", lambda x: (F.length(x) - F.length(F.translate(x, "，,", ""))).cast("double")),
        "_g": F.when(F.length("_c") >= 12, _fours(F.col("_c"))),
    })
    hits = [sum((occurrences(F.col("_t"), p) for p in phrases), F.lit(0)) for phrases in (transitions, generic)]
    repeated = (F.size("_g") - F.size(F.array_distinct("_g"))) / F.size("_g")
    return rows.select(
        *[c for c in paragraphs.columns], "sentences", "chars",
        _uniformity(F.col("_lengths"), 0.75).alias(SIGNALS[0]),
        clamped(hits[0] / F.greatest(F.lit(1.0), F.col("sentences") * 0.75)).alias(SIGNALS[1]),
        clamped(hits[1] / (F.greatest(F.lit(1.0), F.col("chars") / 100.0) * 2.0)).alias(SIGNALS[2]),
        F.when(F.col("_g").isNotNull(), clamped(repeated / 0.12)).otherwise(0.0).alias(SIGNALS[3]),
        F.when(F.exists("_commas", lambda x: x > 0), _uniformity(F.col("_commas"), 1.0)).otherwise(0.0).alias(SIGNALS[4]),
    )


def paragraph_scores(with_signals: DataFrame, s: Style = Style()) -> DataFrame:
    """with_signals(..., action) of eligible paragraphs with score, confidence and severity."""
    weights = (s.sentence_weight, s.transition_weight, s.generic_weight, s.repeated_weight, s.punctuation_weight)
    score = clamped(sum((F.col(n) * w for n, w in zip(SIGNALS, weights, strict=True)), F.lit(0.0)) / s.total)
    confidence = clamped(F.least(F.lit(1.0), F.col("chars") / 400.0) * 0.60 + F.least(F.lit(1.0), F.col("sentences") / 6.0) * 0.40)
    factor = F.when(F.col("action") == "downweight", s.downweight).otherwise(1.0)
    rows = with_signals.where(F.coalesce(F.col("action") != "exclude", F.lit(True)) & (F.col("chars") >= s.min_chars))
    rows = rows.withColumn("score", rounded(score * factor, 6)).withColumn("confidence", rounded(confidence * factor, 6))
    return rows.withColumn("severity", F.when(F.col("score") >= s.high, "high").when(F.col("score") >= s.medium, "medium").otherwise("info"))


def findings(scored: DataFrame, s: Style = Style()) -> DataFrame:
    """Paragraphs that deserve a look; never a diagnosis."""
    kept = scored.where((F.col("severity") != "info") & (F.col("confidence") >= s.min_confidence))
    return kept.select("doc_id", "paragraph_id", "score", "confidence", "severity", stable_id("ai-", F.col("sha256"), F.col("paragraph_id"), F.lit(METHOD)).alias("finding_id"), F.lit(True).alias("non_diagnostic"), F.lit(True).alias("requires_human_review"))


def document_scores(scored: DataFrame) -> DataFrame:
    """Per document: scores weighted by characters and confidence."""
    weight = F.greatest(F.lit(1.0), F.col("chars") * F.col("confidence"))
    grouped = scored.groupBy("doc_id").agg(F.count("*").alias("eligible_paragraphs"), F.count_if(F.col("severity") != "info").alias("suspicious_paragraphs"), (F.sum(F.col("score") * weight) / F.sum(weight)).alias("s"), (F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars")).alias("c"))
    return grouped.select("doc_id", "eligible_paragraphs", "suspicious_paragraphs", rounded("s", 6).alias("ai_likelihood"), rounded("c", 6).alias("confidence"))
