"""Small inline inputs for what the driver tables do not have (Chinese lexicons, page evidence), and what they must give."""

from __future__ import annotations

AI_PARAGRAPHS = """SELECT * FROM VALUES
 ('structured', '首先，通过统一平台全面提升管理效率。其次，通过统一接口全面保障数据质量。此外，持续优化流程降低风险。另一方面，最后形成闭环实现协同。'),
 ('plain', '系统部署在两台服务器上，数据库每晚备份一次。值班人员收到告警后十分钟内响应。') AS t(doc_id, text)"""
# hits: 首先, 其次, 此外, 一方面 inside 另一方面, 另一方面, 最后 over 4 sentences; 通过统一 x2, 全面提升, 全面保障, 持续优化, 降低风险, 形成闭环, 实现协同
AI_EXPECTED = """SELECT doc_id, sentences, transition_density::DOUBLE AS transition_density, generic_phrase_density::DOUBLE AS generic_phrase_density FROM (VALUES ('structured', 4, 1.0, 1.0), ('plain', 2, 0.0, 0.0)) t(doc_id, sentences, transition_density, generic_phrase_density)"""

RULES = """[{"rule_id":"r1","title":"投标函签署","expected_company_names":["星河科技有限公司","星河科技"],"expected_signer_names":["张三"],"require_signature":true,"require_seal":true,"require_date":true,"allowed_pages":[%s],"anchor_terms":["投标人","法定代表人"],"date_not_before":"2026-09-01","date_not_after":"2026-09-30"}]"""
#: (document, allowed page, evidence of page 1).
EVIDENCE = {
    "complete": ("1", '[{"page_number":1,"native_text":"投标人：星河科技有限公司 法定代表人：张三 2026年9月20日","ocr_status":"ok","vision_status":"ok","candidates":[{"candidate_id":"c1","kind":"signature","confidence":0.95},{"candidate_id":"c2","kind":"seal","confidence":0.95}]}]'),
    "wrong": ("1", '[{"page_number":1,"native_text":"投标人：远山公司 法定代表人：李四 2026/10/2","company_names":["远山公司"],"person_names":["李四"],"ocr_status":"ok","vision_status":"ok"}]'),
    "weak": ("1", '[{"page_number":1,"ocr_items":[{"evidence_id":"o1","text":"投标人 星河科技有限公司 法定代表人 张三 2026-09-20","confidence":0.60}],"ocr_status":"ok","vision_status":"ok","candidates":[{"candidate_id":"c1","kind":"signature","confidence":0.50,"quality_flags":["clipped"]},{"candidate_id":"c2","kind":"seal","confidence":0.55,"quality_flags":["unreadable"]}]}]'),
    "elsewhere": ("2", '[{"page_number":1,"native_text":"投标人：星河科技有限公司 张三 2026年9月20日","ocr_status":"ok","vision_status":"ok"}]'),
    "unseen": ("1", '[{"page_number":1,"native_text":"","ocr_status":"failed","vision_status":"disabled"}]'),
    "conflict": ("1", '[{"page_number":1,"native_text":"投标人 星河科技 张三 2026年9月20日 另见 2026.09.21 及 2026年2月30日","ocr_status":"ok","vision_status":"ok","candidates":[{"candidate_id":"c1","kind":"signature","confidence":0.9},{"candidate_id":"c2","kind":"seal","confidence":0.9}]}]'),
}
SIG_FINDINGS = """SELECT document_id, issue_code, severity, score::DOUBLE AS score FROM (VALUES
 ('wrong', 'missing_signature', 'high', 0.9), ('wrong', 'missing_seal', 'high', 0.9), ('wrong', 'company_name_mismatch', 'high', 0.88), ('wrong', 'signer_name_mismatch', 'high', 0.88), ('wrong', 'date_out_of_range', 'high', 0.9),
 ('weak', 'signature_low_confidence', 'medium', 0.5), ('weak', 'signature_quality_issue', 'medium', 0.65), ('weak', 'seal_low_confidence', 'medium', 0.45), ('weak', 'seal_quality_issue', 'medium', 0.65), ('weak', 'company_name_low_confidence', 'medium', 0.4), ('weak', 'signer_name_low_confidence', 'medium', 0.4), ('weak', 'date_low_confidence', 'medium', 0.4),
 ('elsewhere', 'required_location_missing', 'high', 0.9), ('elsewhere', 'missing_signature', 'high', 0.9), ('elsewhere', 'missing_seal', 'high', 0.9), ('elsewhere', 'company_name_evidence_unavailable', 'medium', 0.6), ('elsewhere', 'signer_name_evidence_unavailable', 'medium', 0.6), ('elsewhere', 'date_evidence_unavailable', 'medium', 0.6),
 ('unseen', 'required_location_missing', 'high', 0.9), ('unseen', 'signature_evidence_unavailable', 'medium', 0.6), ('unseen', 'seal_evidence_unavailable', 'medium', 0.6), ('unseen', 'company_name_evidence_unavailable', 'medium', 0.6), ('unseen', 'signer_name_evidence_unavailable', 'medium', 0.6), ('unseen', 'date_evidence_unavailable', 'medium', 0.6),
 ('conflict', 'conflicting_dates', 'medium', 0.65)) t(document_id, issue_code, severity, score)"""
SIG_RULES = """SELECT * FROM (VALUES ('complete', 'passed', 0, '星河科技有限公司', '张三', '2026-09-20'), ('wrong', 'failed', 5, NULL, NULL, '2026-10-02'), ('weak', 'review', 7, '星河科技有限公司', '张三', '2026-09-20'),
 ('elsewhere', 'failed', 6, NULL, NULL, NULL), ('unseen', 'failed', 6, NULL, NULL, NULL), ('conflict', 'review', 1, '星河科技', '张三', '2026-09-20')) t(document_id, status, finding_count, matched_company_name, matched_signer_name, matched_date)"""

OCR = """SELECT 1 AS page_number, 'ok' AS status, '[{"evidence_id":"a","text":"x","confidence":0.91,"bbox":{"x":1,"y":1,"w":5,"h":5}},{"evidence_id":"b","text":"y","confidence":0.40},{"evidence_id":"c","text":"z","confidence":1.1},{"evidence_id":"d","text":"w","confidence":0.9,"bbox":{"x":1,"y":1,"w":0,"h":5}}]' AS items UNION ALL SELECT 2, 'failed', '[]'"""
OCR_EXPECTED = "SELECT * FROM (VALUES (1, 'a', NULL, false), (1, 'b', NULL, true), (1, 'c', 'confidence', false), (1, 'd', 'bbox', false), (2, NULL, NULL, true)) t(page_number, evidence_id, error, review)"

#: Findings on a target of two paragraphs and a table of one cell.
FINDINGS = """SELECT * FROM VALUES
 ('f1', 'text_similarity', 'high', 'target', 'other', 0.95D, 'first', '{}', 0, NULL, NULL, NULL),
 ('f2', 'text_similarity', 'medium', 'other', 'target', 0.70D, 'second', '{}', NULL, 0, 0, 0),
 ('f3', 'ai_likelihood', 'info', 'target', NULL, 0.20D, 'third', '{}', 1, NULL, NULL, NULL),
 ('f4', 'format_issue', 'low', 'target', NULL, NULL, 'fourth', '{}', 99, NULL, NULL, NULL),
 ('f5', 'format_issue', 'low', 'elsewhere', NULL, NULL, 'fifth', '{}', 0, NULL, NULL, NULL),
 ('f1', 'text_similarity', 'high', 'target', 'other', 0.95D, 'first', '{}', 0, NULL, NULL, NULL)
 AS t(finding_id, type, severity, document_id, peer_document_id, score, summary, evidence, p, t, r, c)"""
PLAN_EXPECTED = """SELECT * FROM (VALUES ('f1', 'source', NULL), ('f1', 'source', 'duplicate_finding'), ('f2', 'peer', NULL), ('f3', 'source', 'below_min_severity'), ('f4', 'source', 'paragraph_index_out_of_range'), ('f5', NULL, 'finding_targets_another_document')) t(finding_id, role, skip_reason)"""
SKIPS_EXPECTED = """SELECT * FROM (VALUES ('target', 'duplicate_finding', 1), ('target', 'below_min_severity', 1), ('target', 'paragraph_index_out_of_range', 1), ('target', 'finding_targets_another_document', 1)) t(target, skip_reason, n)"""
