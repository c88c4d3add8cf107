"""Which findings become comments of a document, where, and why others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Annotation
from .report import SEVERITIES, severity_rank


def comment_text(s: Annotation = Annotation()) -> Column:
    """The comment on a finding with its role; lines without a value are left out."""
    evidence = F.when(F.length("evidence") > s.max_evidence_chars, F.concat(F.substring("evidence", 1, max(0, s.max_evidence_chars - 1)), F.lit("…"))).otherwise(F.col("evidence"))
    lines = [
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "summary"),
        F.concat(F.lit("类型: "), "type"),
        F.concat(F.lit("Finding ID: "), "finding_id"),
        F.concat(F.lit("定位角色: "), F.when(F.col("role") == "source", "主文档").otherwise("对端文档")),
        F.when(F.col("score").isNotNull(), F.concat(F.lit("风险/相似度分: "), F.format_string("%.1f%%", F.col("score") * 100))),
        F.when(F.length("peer_document_id") > 0, F.concat(F.lit("关联文档: "), "peer_document_id")),
        F.when((F.length("evidence") > 0) & F.lit(s.include_evidence and s.max_evidence_chars > 0), F.concat(F.lit("证据: "), evidence)),
        F.when(F.col("type") == "ai_likelihood", "提示: AI 疑似度仅为辅助信号，不能证明文本由 AI 生成，必须人工复核。"),
    ]
    return F.concat_ws("\n", *lines)


def plan(findings: DataFrame, targets: DataFrame, shapes: DataFrame, cells: DataFrame, s: Annotation = Annotation()) -> DataFrame:
    """For each (target document, finding): its comment's place, or the reason it is skipped.

    findings(finding_id, type, severity, document_id, peer_document_id, score, summary, evidence, locator, peer_locator), the
    locators structs of paragraph_index, table_index, row_index and cell_index; targets(target); shapes(target, paragraphs,
    tables); cells(target, table_index, row_index, cells, first_paragraph array<boolean>). Gates apply in this order: another
    document, a finding seen before, severity, the greatest number of comments, the locator.
    """
    own = F.col("document_id") == F.col("target")
    peer = (F.col("peer_document_id") == F.col("target")) & F.col("peer_locator").isNotNull()
    rows = findings.crossJoin(F.broadcast(targets)) if "target" not in findings.columns else findings
    rows = rows.withColumn("role", F.when(own, "source").when(peer, "peer")).withColumn("place", F.when(own, F.col("locator")).when(peer, F.col("peer_locator")))
    rows = rows.withColumn("level", severity_rank(F.col("severity")))
    best_first = [F.desc("level"), F.desc(F.coalesce("score", F.lit(0.0))), F.desc("finding_id")]
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("target", "finding_id", "role").orderBy(*best_first)))
    low = SEVERITIES.index(s.min_severity) + 1
    eligible = F.col("role").isNotNull() & (F.col("seen") == 1) & (F.col("level") >= low)
    rows = rows.withColumn("p", F.col("place.paragraph_index")).withColumn("t", F.col("place.table_index"))
    rows = rows.withColumn("r", F.coalesce("place.row_index", F.lit(0))).withColumn("c", F.coalesce("place.cell_index", F.lit(0)))
    rows = rows.join(F.broadcast(shapes), "target", "left").join(cells.withColumnRenamed("table_index", "t").withColumnRenamed("row_index", "r"), ["target", "t", "r"], "left")
    reason = (
        F.when(F.col("p").isNotNull(), F.when((F.col("p") < 0) | (F.col("p") >= F.col("paragraphs")), "paragraph_index_out_of_range"))
        .when(F.col("t").isNotNull(), F.when((F.col("t") < 0) | (F.col("t") >= F.col("tables")), "table_index_out_of_range").when(F.col("cells").isNull(), "row_index_out_of_range").when((F.col("c") < 0) | (F.col("c") >= F.col("cells")), "cell_index_out_of_range"))
        .otherwise("locator_not_supported")
    )
    rows = rows.withColumn("located", reason)
    # a comment counts once it is written: eligible findings with a place before this one
    before = Window.partitionBy("target").orderBy(*best_first).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("written", F.coalesce(F.sum(F.when(eligible & F.col("located").isNull(), 1).otherwise(0)).over(before), F.lit(0)))
    skip = F.when(F.col("role").isNull(), "finding_targets_another_document").when(F.col("seen") > 1, "duplicate_finding").when(F.col("level") < low, "below_min_severity").when(F.col("written") >= s.max_comments, "max_comments_reached").otherwise(F.col("located"))
    return rows.select("target", "finding_id", "role", "severity", "p", "t", "r", "c", skip.alias("skip_reason"), F.when(skip.isNull(), comment_text(s)).alias("comment"))


def skip_reasons(planned: DataFrame) -> DataFrame:
    return planned.where("skip_reason IS NOT NULL").groupBy("target", "skip_reason").agg(F.count("*").alias("n"))
