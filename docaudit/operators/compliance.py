"""Signature, seal, identity and date rules over page evidence, all documents and rules in one plan.

Presence, identity and dates are judged per (document, rule) on the rule's relevant pages. Evidence that was not available
is reported as such and never as missing; nothing here says whether a signature or a seal is genuine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, rounded

#: Fixed value: a date of this century, by year, month and day.
DATE = r"(?<!\d)(20\d{2})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})\s*日?"
KEY = ["document_id", "rule_id"]
FINDING = "document_id string, rule_id string, issue_code string, severity string, page_number int, score double, finding_id string"


def text_sources(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(document_id, page_number, place, text, confidence, source_id) of all text on a page, in order.

    pages(document_id, page_number, native_text, ocr_items array<struct<evidence_id, text, confidence>>, company_names,
    person_names, date_values, ocr_status, vision_status); candidates(..., recognized_text, confidence).
    """
    key = [F.col("document_id"), F.col("page_number")]
    prefix = F.concat(F.lit("page-"), F.col("page_number"))
    blank = F.length(F.trim("text")) > 0
    native = pages.select(*key, F.lit(0).alias("kind"), F.lit(0).alias("place"), F.col("native_text").alias("text"), F.lit(1.0).alias("confidence"), F.concat(prefix, F.lit(":native")).alias("source_id"))
    ocr = pages.select(*key, F.posexplode("ocr_items").alias("place", "i")).select(*key, F.lit(1).alias("kind"), "place", F.trim("i.text").alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("i.confidence", F.lit(0.0)))).alias("confidence"), F.coalesce("i.evidence_id", F.concat(prefix, F.lit(":ocr:"), F.col("place"))).alias("source_id"))
    out = native.unionByName(ocr)
    for kind, column in enumerate(("company_names", "person_names", "date_values"), 2):
        out = out.unionByName(pages.select(*key, F.posexplode(column).alias("place", "text")).select(*key, F.lit(kind).alias("kind"), "place", "text", F.lit(1.0).alias("confidence"), F.concat(prefix, F.lit(f":{column}:"), F.col("place")).alias("source_id")))
    seen = candidates.where("recognized_text IS NOT NULL").select(*key, F.lit(5).alias("kind"), F.lit(0).alias("place"), F.col("recognized_text").alias("text"), "confidence", F.col("candidate_id").alias("source_id"))
    return out.unionByName(seen).where(blank)


def relevant_pages(rules: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(document_id, rule_id, page_number, ..., anchored, located): allowed pages with an anchor, or all allowed if none has one."""
    texts = sources.groupBy("document_id", "page_number").agg(folded(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("kind", "place", "text"))), lambda s: s["text"]))).alias("page_text"))
    allowed = (F.size("allowed_pages") == 0) | F.array_contains("allowed_pages", F.col("page_number"))
    rows = rules.join(pages, "document_id").where(allowed).join(texts, ["document_id", "page_number"], "left")
    terms = F.filter(F.transform("anchor_terms", lambda t: folded(t)), lambda t: F.length(t) > 0)
    anchored = F.exists(terms, lambda t: F.contains(F.coalesce("page_text", F.lit("")), t))
    rows = rows.withColumn("anchored", anchored)
    some = rows.groupBy(KEY).agg(F.bool_or("anchored").alias("some"))
    rows = rows.join(some, KEY).where(F.col("anchored") | ~F.col("some") | (F.size("anchor_terms") == 0))
    return rows.withColumn("located", F.col("some") | (F.size("anchor_terms") == 0))


def _finding(code: Column | str, severity: str, page: Column, score: Column | float) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    score = F.lit(score) if isinstance(score, float) else score
    return F.struct(code.alias("issue_code"), F.lit(severity).alias("severity"), page.cast("int").alias("page_number"), score.cast("double").alias("score"))


def _none() -> Column:
    return F.lit(None).cast("struct<issue_code:string,severity:string,page_number:int,score:double>")


def _presence(kind: str, required: str) -> list[Column]:
    """Findings on signatures or seals of a (document, rule) row."""
    c = F.filter("candidates", lambda x: x["kind"] == kind)
    sure = F.exists(c, lambda x: x["confidence"] >= F.col("minimum_candidate_confidence"))
    flawed = F.filter(c, lambda x: F.size(x["quality_flags"]) > 0)
    best, page = F.get(c, F.lit(0)), F.col("first_page")
    unseen = (F.size(c) == 0) & F.col("has_pages") & F.col("some_unseen")
    main = F.when(unseen, _finding(f"{kind}_evidence_unavailable", "medium", page, 0.6)).when((F.size(c) > 0) & ~sure, _finding(f"{kind}_low_confidence", "medium", best["page_number"], rounded(1 - best["confidence"], 4))).when(F.size(c) == 0, _finding(f"missing_{kind}", "high", page, 0.9)).otherwise(_none())
    flaw = F.when(F.size(flawed) > 0, _finding(f"{kind}_quality_issue", "medium", F.get(flawed, F.lit(0))["page_number"], 0.65)).otherwise(_none())
    return [F.when(F.col(required), main).otherwise(_none()), F.when(F.col(required) & ~unseen, flaw).otherwise(_none())]


def _identity(kind: str, expected: str) -> Column:
    match, page = F.col(f"{kind}_match"), F.col("first_page")
    code = F.when(F.col(f"{kind}_seen"), F.lit(f"{kind}_name_mismatch")).otherwise(F.lit(f"missing_{kind}_name"))
    return F.when(F.size(expected) == 0, _none()).when(~F.col("has_text"), _finding(f"{kind}_name_evidence_unavailable", "medium", page, 0.6)).when(match.isNull(), _finding(code, "high", page, 0.88)).when(match["confidence"] < F.col("minimum_text_confidence"), _finding(f"{kind}_name_low_confidence", "medium", page, rounded(1 - match["confidence"], 4))).otherwise(_none())


def _dates() -> list[Column]:
    page, required = F.col("first_page"), F.col("require_date")
    sure = F.col("sure_dates")
    within = F.col("dates_within")
    main = F.when(~F.col("has_date_text"), _finding("date_evidence_unavailable", "medium", page, 0.6)).when((F.size(sure) == 0) & F.col("best_date").isNotNull(), _finding("date_low_confidence", "medium", page, rounded(1 - F.col("best_date")["confidence"], 4))).when(F.size(sure) == 0, _finding("missing_date", "high", page, 0.85)).otherwise(_none())
    known = required & F.col("has_date_text") & (F.size(sure) > 0)
    return [F.when(required, main).otherwise(_none()), F.when(known & (F.size(sure) > 1), _finding("conflicting_dates", "medium", page, 0.65)).otherwise(_none()), F.when(known & (F.size(within) == 0), _finding("date_out_of_range", "high", page, 0.9)).otherwise(_none())]


def _ids(kind: str) -> Column:
    return F.transform(F.filter("candidates", lambda x: x["kind"] == kind), lambda x: x["candidate_id"]).alias(f"{kind}_candidate_ids")


def evaluated(rules: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per (document, rule): what was found, and `findings`, an array of structs."""
    sources = text_sources(pages, candidates)
    relevant = relevant_pages(rules, pages, sources)
    places = relevant.select(*KEY, "page_number")
    page_facts = relevant.groupBy(KEY).agg(
        F.min("page_number").alias("first_page"), F.sort_array(F.collect_set("page_number")).alias("relevant_pages"), F.bool_and("located").alias("located"),
        F.bool_or(F.col("vision_status") != "ok").alias("some_unseen"),
        F.bool_or((F.length(F.trim("native_text")) > 0) | (F.size("company_names") > 0) | (F.size("person_names") > 0) | (F.size("date_values") > 0) | (F.col("ocr_status") == "ok")).alias("has_text"),
        F.bool_or((F.length(F.trim("native_text")) > 0) | (F.size("date_values") > 0) | (F.col("ocr_status") == "ok")).alias("has_date_text"),
        F.bool_or(F.exists("company_names", lambda x: F.length(F.trim(x)) > 0)).alias("company_seen"),
        F.bool_or(F.exists("person_names", lambda x: F.length(F.trim(x)) > 0)).alias("signer_seen"),
    )
    found = places.join(candidates, ["document_id", "page_number"]).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("_c"), "candidate_id", "kind", "confidence", "page_number", "quality_flags"))).alias("candidates"))
    texts = places.join(sources, ["document_id", "page_number"])
    limits = rules.select(*KEY, "expected_company_names", "expected_signer_names", "minimum_text_confidence", "date_not_before", "date_not_after")
    rows = texts.join(limits, KEY)

    def matches(kind: str, expected: str) -> DataFrame:
        names = rows.select(*KEY, "page_number", "kind", "place", "confidence", "source_id", folded(F.col("text")).alias("t"), F.posexplode(expected).alias("n", "name"))
        hit = names.where((F.length(folded(F.col("name"))) > 0) & F.contains("t", folded(F.col("name"))) & (F.col("confidence") > 0))
        # the highest confidence; of equals the first in page order
        best = F.struct("confidence", -F.col("page_number"), -F.col("kind"), -F.col("place"), -F.col("n"))
        return hit.groupBy(KEY).agg(F.max_by(F.struct("name", "confidence", "source_id"), best).alias(f"{kind}_match"))

    parts = F.regexp_extract_all("text", F.lit(DATE), 0)
    day = rows.select(*KEY, "confidence", "source_id", "minimum_text_confidence", "date_not_before", "date_not_after", F.explode(parts).alias("d"))
    day = day.withColumn("date", F.try_to_date(F.concat_ws("-", *[F.regexp_extract("d", DATE, i) for i in (1, 2, 3)]), "yyyy-M-d")).where("date IS NOT NULL")
    within = (F.coalesce(F.col("date") >= F.col("date_not_before"), F.lit(True))) & (F.coalesce(F.col("date") <= F.col("date_not_after"), F.lit(True)))
    sure = F.col("confidence") >= F.col("minimum_text_confidence")
    dates = day.groupBy(KEY).agg(F.sort_array(F.collect_set(F.when(sure, F.col("date")))).alias("sure_dates"), F.sort_array(F.collect_set(F.when(sure & within, F.col("date")))).alias("dates_within"), F.max_by(F.struct("date", "confidence"), F.struct("confidence", F.datediff(F.lit("2200-01-01"), "date"))).alias("best_date"))
    out = rules.join(page_facts, KEY, "left").join(found, KEY, "left").join(matches("company", "expected_company_names"), KEY, "left").join(matches("signer", "expected_signer_names"), KEY, "left").join(dates, KEY, "left")
    none = F.array().cast("array<date>")
    out = out.withColumn("has_pages", F.col("first_page").isNotNull()).withColumn("first_page", F.coalesce("first_page", F.lit(1))).withColumn("candidates", F.coalesce("candidates", F.array().cast("array<struct<_c:double,candidate_id:string,kind:string,confidence:double,page_number:int,quality_flags:array<string>>>")))
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("located", "some_unseen", "has_text", "has_date_text", "company_seen", "signer_seen")} | {c: F.coalesce(c, none) for c in ("sure_dates", "dates_within")})
    out = out.withColumn("relevant_pages", F.coalesce("relevant_pages", F.array().cast("array<int>")))
    place = F.when(~F.col("located"), _finding("required_location_missing", "high", F.col("first_page"), 0.9)).otherwise(_none())
    every = F.array(place, *_presence("signature", "require_signature"), *_presence("seal", "require_seal"), _identity("company", "expected_company_names"), _identity("signer", "expected_signer_names"), *_dates())
    chosen = F.when(F.size("dates_within") > 0, F.get("dates_within", F.lit(0))).when(F.size("sure_dates") > 0, F.get("sure_dates", F.lit(0))).otherwise(F.col("best_date.date"))
    return out.select(*KEY, "relevant_pages", F.col("company_match.name").alias("matched_company_name"), F.col("signer_match.name").alias("matched_signer_name"), F.when(F.col("require_date") & F.col("has_date_text"), chosen).cast("string").alias("matched_date"), _ids("signature"), _ids("seal"), F.filter(every, lambda f: f.isNotNull()).alias("findings"))


def findings(evaluation: DataFrame) -> DataFrame:
    """One row per issue, with its stable id."""
    rows = evaluation.select(*KEY, F.explode("findings").alias("f")).select(*KEY, "f.*")
    ids = F.concat(F.lit("finding-signature-"), F.substring(F.sha2(F.concat_ws("|", "document_id", "rule_id", "issue_code", F.col("page_number").cast("string")), 256), 1, 20))
    return rows.withColumn("finding_id", ids)


def rule_status(evaluation: DataFrame) -> DataFrame:
    """passed, review or failed, and the number of findings of each rule."""
    grave = F.exists("findings", lambda f: f["severity"].isin("high", "critical"))
    return evaluation.select(*KEY, F.when(grave, "failed").when(F.size("findings") > 0, "review").otherwise("passed").alias("status"), F.size("findings").alias("finding_count"), "matched_company_name", "matched_signer_name", "matched_date", "relevant_pages", F.lit(False).alias("authenticity_check"))


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates of a page and kind from the surest on."""
    order = Window.partitionBy("document_id", "page_number", "kind").orderBy(F.desc("confidence"), "candidate_id")
    return candidates.withColumn("rank", F.row_number().over(order))
