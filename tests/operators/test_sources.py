"""Files made in the test, read and written back; queries against their SQL on the smallest tables."""

import io
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from docaudit.plans import queries
from docaudit.sources import dispatch, docx, evidence, pdf

DOCUMENT = """<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>
<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>技术方案</w:t></w:r></w:p><w:p><w:r><w:t>  </w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:b/><w:rFonts w:ascii="Arial"/><w:sz w:val="24"/></w:rPr><w:t>bold</w:t></w:r><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t> plain</w:t></w:r><w:r><w:drawing r:embed="rId1"/></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>指标</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>值</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>并发</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>100</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:bottom="1440" w:left="1800" w:right="1440"/></w:sectPr></w:body></w:document>"""


def package() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"></Types>')
        z.writestr("word/document.xml", DOCUMENT)
        z.writestr("word/styles.xml", '<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://x/image" Target="media/a.png"/><Relationship Id="rId2" Type="http://x/image" Target="media/missing.png"/></Relationships>')
        z.writestr("word/media/a.png", b"pixels")
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package())
    row = docx.read_docx(spark, str(tmp_path)).first()
    assert [(p.id, p.raw_index, p.text, p.heading_level) for p in row.paragraphs] == [("p-000001", 0, "技术方案", 1), ("p-000002", 2, "bold plain", None)]
    runs = row.paragraphs[1].runs
    assert [(r.text, r.bold, r.font, r.size) for r in runs] == [("bold", True, "Arial", 12.0), (" plain", False, None, None)]
    assert row.tables[0].rows == [["指标", "值"], ["并发", "100"]] and row.images[0].paragraph_index == 2 and len(row.warnings) == 1
    assert row.margins.left == 3.175 and row.document_id == "doc-" + row.sha256[:24]
    with pytest.raises(ValueError):
        docx.parse(b"not-a-docx")


def test_files_of_any_kind(spark, tmp_path):
    made = docx.build([{"text": "Title", "heading_level": 2}, {"text": "a <body> & more\x00", "font": "Serif", "size": 12.0}], {"left": 3.81, "right": 2.54}, {"title": "t"})
    (tmp_path / "b.DOCX").write_bytes(made)
    (tmp_path / "broken.docx").write_bytes(b"nothing")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< /Length 30 >>\nstream\nBT (first text) Tj ET\nendstream\nendobj\n")
    (tmp_path / "d.txt").write_bytes(b"left alone")
    rows = {r.path.rpartition("/")[2]: r for r in dispatch.read_documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"b.DOCX", "broken.docx", "c.pdf"} and "not a Word document" in rows["broken.docx"].error
    word = rows["b.DOCX"]
    assert [(p.text, p.heading_level) for p in word.paragraphs] == [("Title", 2), ("a <body> & more", None)] and word.paragraphs[1].runs[0].size == 12.0
    assert (word.margins.left, word.margins.right, word.metadata["title"], word.error) == (3.81, 2.54, "t", None)
    assert rows["c.pdf"].page_count == 1 and [(p.page, p.text) for p in rows["c.pdf"].paragraphs] == [(1, "first text")]
    assert "not supported" in dispatch.parse(b"x", "d.txt")["error"]


def test_comments_are_written_back():
    out = docx.comment(package(), [({"p": 2}, "first\nsecond"), ({"p": None, "t": 0, "r": 1, "c": 1}, "cell")])
    files = zipfile.ZipFile(io.BytesIO(out))
    assert files.read("word/comments.xml").count(b"<w:comment ") == 2 and b"commentRangeStart" in files.read("word/document.xml")
    assert b"comments.xml" in files.read("[Content_Types].xml") and b"comments.xml" in files.read("word/_rels/document.xml.rels")
    again = docx.parse(out)
    assert [p["text"] for p in again["paragraphs"]] == [p["text"] for p in docx.parse(package())["paragraphs"]]


def test_pdf():
    stream = zlib.compress(b"BT /F1 12 Tf 72 72 Td (Hello \\(PDF\\)) Tj ET BT [(sec) -20 (ond)] TJ ET")
    content = b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << /Filter /FlateDecode /Length 1 >> stream\n" + stream + b"\nendstream endobj\n%%EOF"
    got = pdf.parse(content)
    assert got["page_count"] == 1 and [p["text"] for p in got["paragraphs"]] == ["Hello (PDF)", "second"]
    with pytest.raises(ValueError):
        pdf.parse(b"plain")


def test_finding_payloads(spark):
    rows = spark.createDataFrame([('[{"finding_id":"a","score":0.5}]',), ('{"findings":[{"finding_id":"b","source_locator":{"page":2}}]}',), ("[]",)], "payload string")
    assert {(r.finding_id, r.score) for r in evidence.findings(rows).collect()} == {("a", 0.5), ("b", None)}


def test_bad_rules_are_set_apart(spark):
    rules = ['{"rule_id":"","title":"t"}', '{"rule_id":"a","title":" "}', '{"rule_id":"b","title":"t","allowed_pages":[0]}', '{"rule_id":"c","title":"t","date_not_before":"2026-02-01","date_not_after":"2026-01-01"}', '{"rule_id":"d","title":"t","minimum_text_confidence":1.5}', '{"rule_id":"e","title":"t"}', '{"rule_id":"f","title":"t"}', '{"rule_id":"f","title":"t"}']
    got = evidence.rules(spark.createDataFrame([("d", "[" + ",".join(rules) + "]")], "document_id string, payload string"))
    assert {r.rule_id: r.error is None for r in got.collect()} == {"": False, "a": False, "b": False, "c": False, "d": False, "e": True, "f": False}


SMALL = ["paragraphs", "interference_items", "section_paths", "recall_candidates", "phash_bits", "run_signature", "style_outliers", "margin_asymmetry", "ai_lexicon", "sig_findings", "sig_rules", "ocr_evidence", "audit_tampered", "task_transitions_invalid", "package_diff", "annotation_plan", "annotation_skip_reasons"]


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "lineitem", "orders", "part", "supplier", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    relation = con.sql(queries.ORACLES[name])
    columns = list(relation.columns)
    assert sorted(df.columns) == sorted(columns)
    key = lambda rows: sorted(tuple(str(x) if not isinstance(x, float) else round(x, 9) for x in r) for r in rows)
    plain = lambda x: float(x) if type(x).__name__ == "Decimal" else x
    assert key(map(tuple, df.select(*[F.col(c) for c in columns]).collect())) == key(tuple(map(plain, r)) for r in relation.fetchall())
