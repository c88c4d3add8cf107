"""JSON payloads as tables: findings, signature rules, page evidence, OCR items. Bad rows are set apart with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATOR = "struct<kind:string,index:int,page:int,paragraph_index:int,table_index:int,row_index:int,cell_index:int,part:string>"
FINDING = f"struct<finding_id:string,type:string,severity:string,document_id:string,peer_document_id:string,source_locator:{LOCATOR},peer_source_locator:{LOCATOR},score:double,summary:string,evidence:string,metadata:string>"
RULE = "struct<rule_id:string,title:string,expected_company_names:array<string>,expected_signer_names:array<string>,signer_role:string,require_signature:boolean,require_seal:boolean,require_date:boolean,allowed_pages:array<int>,anchor_terms:array<string>,date_not_before:string,date_not_after:string,minimum_candidate_confidence:double,minimum_text_confidence:double>"
BBOX = "struct<x:double,y:double,w:double,h:double>"
ITEM = f"struct<evidence_id:string,text:string,confidence:double,polygon:array<array<double>>,bbox:{BBOX}>"
CANDIDATE = f"struct<candidate_id:string,kind:string,bbox:{BBOX},confidence:double,recognized_text:string,quality_flags:array<string>,detector:string>"
PAGE = f"struct<page_number:int,native_text:string,ocr_items:array<{ITEM}>,company_names:array<string>,person_names:array<string>,date_values:array<string>,ocr_status:string,vision_status:string,candidates:array<{CANDIDATE}>>"
#: From this confidence on an OCR item needs no review.
SURE = 0.82


def _listed(payload: Column, key: str, kind: str) -> Column:
    """An array, or an object that holds it under the key."""
    direct = F.from_json(payload, f"array<{kind}>")
    return F.when(F.ltrim(payload).startswith("["), direct).otherwise(F.from_json(payload, f"struct<{key}:array<{kind}>>")[key])


def findings(payloads: DataFrame) -> DataFrame:
    """payloads(payload) of findings, one row each."""
    return payloads.select(F.explode(_listed(F.col("payload"), "findings", FINDING)).alias("f")).select("f.*").where("finding_id IS NOT NULL")


def rules(payloads: DataFrame) -> DataFrame:
    """payloads(document_id, payload) of signature rules with defaults, and `error` where a rule is not usable."""
    r = payloads.select("document_id", F.explode(_listed(F.col("payload"), "requirements", RULE)).alias("r")).select("document_id", "r.*")
    strings = F.array().cast("array<string>")
    r = r.withColumns({c: F.coalesce(c, strings) for c in ("expected_company_names", "expected_signer_names", "anchor_terms")} | {"allowed_pages": F.coalesce("allowed_pages", F.array().cast("array<int>"))})
    r = r.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("require_signature", "require_seal", "require_date")})
    r = r.withColumns({c: F.try_to_date(c, "yyyy-MM-dd") for c in ("date_not_before", "date_not_after")})
    r = r.withColumn("minimum_candidate_confidence", F.coalesce("minimum_candidate_confidence", F.lit(0.65))).withColumn("minimum_text_confidence", F.coalesce("minimum_text_confidence", F.lit(0.82)))
    n = r.groupBy("document_id", "rule_id").agg(F.count("*").alias("times"))
    r = r.join(n, ["document_id", "rule_id"], "left")
    share = lambda c: (F.col(c) >= 0) & (F.col(c) <= 1)
    error = F.when(F.length(F.trim(F.coalesce("rule_id", F.lit("")))) == 0, "rule_id").when(F.length(F.trim(F.coalesce("title", F.lit("")))) == 0, "title").when(F.col("times") > 1, "rule_id is not unique").when(F.exists("allowed_pages", lambda p: p < 1), "allowed_pages").when(~share("minimum_candidate_confidence") | ~share("minimum_text_confidence"), "confidence").when(F.col("date_not_before") > F.col("date_not_after"), "dates")
    return r.withColumn("error", error).drop("times")


def pages(native: DataFrame, external: DataFrame) -> DataFrame:
    """native(document_id, page_number, text) merged with external(document_id, payload) evidence by page, whichever has it."""
    own = native.groupBy("document_id", F.coalesce("page_number", F.lit(1)).alias("page_number")).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])).alias("own_text"))
    other = external.select("document_id", F.explode(_listed(F.col("payload"), "pages", PAGE)).alias("p")).select("document_id", "p.*")
    both = own.join(other, ["document_id", "page_number"], "full_outer")
    strings = F.array().cast("array<string>")
    text = F.concat_ws("\n", *[F.when(F.length(F.trim(c)) > 0, F.col(c)) for c in ("own_text", "native_text")])
    return both.select("document_id", "page_number", text.alias("native_text"), F.coalesce("ocr_items", F.array().cast(f"array<{ITEM}>")).alias("ocr_items"), *[F.coalesce(c, strings).alias(c) for c in ("company_names", "person_names", "date_values")], F.coalesce("ocr_status", F.lit("not_run")).alias("ocr_status"), F.coalesce("vision_status", F.lit("not_run")).alias("vision_status"), F.coalesce("candidates", F.array().cast(f"array<{CANDIDATE}>")).alias("candidates"))


def candidates(page_rows: DataFrame) -> DataFrame:
    """One row per visual candidate; one without an id is named by its page and place."""
    rows = page_rows.select("document_id", "page_number", F.posexplode("candidates").alias("place", "c"))
    return rows.select("document_id", "page_number", F.coalesce("c.candidate_id", F.concat(F.lit("candidate-"), F.col("page_number"), F.lit("-"), F.col("place") + 1)).alias("candidate_id"), "c.kind", "c.bbox", F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"), "c.recognized_text", F.coalesce("c.quality_flags", F.array().cast("array<string>")).alias("quality_flags"))


def ocr_checked(results: DataFrame) -> DataFrame:
    """results(page_number, status, items array<ITEM>): items with `review` and `error`; a failed page may not have items."""
    rows = results.select("page_number", "status", F.explode_outer("items").alias("i")).select("page_number", "status", "i.*")
    number = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    box = number(F.col("bbox.x")) & number(F.col("bbox.y")) & (F.col("bbox.w") > 0) & (F.col("bbox.h") > 0)
    error = (
        F.when((F.col("status") != "ok") & F.col("evidence_id").isNotNull(), "a page that failed has no items")
        .when(F.col("evidence_id").isNull(), None)
        .when(~(number(F.col("confidence")) & (F.col("confidence") >= 0) & (F.col("confidence") <= 1)), "confidence")
        .when(F.col("bbox").isNotNull() & ~box, "bbox")
        .when(F.col("polygon").isNotNull() & (F.size("polygon") < 4), "polygon")
    )
    review = F.when(F.col("status") != "ok", True).otherwise(F.coalesce(F.col("confidence") < SURE, F.lit(False)))
    return rows.select("page_number", "status", "evidence_id", "text", "confidence", error.alias("error"), review.alias("review"))
