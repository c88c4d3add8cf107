"""The pipeline's stages on a small corpus, each against what it must do to its own input."""

import zlib

import corpus_pipeline
from docaudit.llm import common, ngram_join, tokens


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = common.written(stage(spark, before, sf_dir), "test")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert docs.count() == docs.select("doc_id").distinct().count() <= before.count()
        if name == "n-gram Jaccard join":
            roots = {r.doc_id: r.component_id for r in ngram_join.near_documents(before).collect()}
            assert {r.doc_id for r in docs.collect()} == {d for d, c in roots.items() if d == c}
        if name == "benchmark decontamination":
            items = [r.text for r in common.table(spark, sf_dir, "benchmark").collect()]
            kept = {r.doc_id for r in docs.collect()}
            for r in before.collect():
                if any(i in (r.text or "") for i in items):
                    assert r.doc_id not in kept
            last = docs
    whole = {}
    for r in docs.collect():
        whole.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    memo = tokens.memo(tokens.vocabulary("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in last.collect()}
    assert set(whole) == set(texts)
    for d, parts in list(whole.items())[:40]:
        ids = memo.plain(texts[d] or "") + b"\0\0\0\0"
        at = 0
        for start, n, crc, total in sorted(parts):
            assert start == at and total == len(ids) // 4 and crc == zlib.crc32(ids[4 * start : 4 * (start + n)])
            at += n
        assert 4 * at == len(ids)


def test_stages_take_odd_rows(spark, tmp_path):
    sf_dir = str(tmp_path)
    good = [r.text for r in common.table(spark, "/root/testdata/sf0.001", "documents").where("length(text) BETWEEN 300 AND 2000").orderBy("doc_id").limit(30).collect()]
    leak = "What is the height of the seventh tower in the old harbour town of Brennholm? It measures ninety three cubits."
    rows = [(i, t) for i, t in enumerate(good)] + [(100, None), (101, ""), (None, "a text that has no number but is there " + good[0][:40]), (None, None), (3, good[3]), (5, "another text of number five, " + leak), (102, "nothing but filler before it. " + leak)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "clash", 7) for i, t in rows], "doc_id long, text string, n_chars long, score string, key int")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(101, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[3:]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            if given is not docs:
                assert out.count() == 0
            elif name == "benchmark decontamination":
                kept = [(r.doc_id, r.text) for r in out.collect()]
                # of two rows with one doc_id, the one with the leak goes
                assert (5, good[5]) in kept and len(kept) == len(rows) - 2 and not any(t and leak in t for _, t in kept)
