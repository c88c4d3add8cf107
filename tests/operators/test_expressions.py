"""Expressions against small Python oracles."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docaudit import config
from docaudit.functions import image, pixels, text
from docaudit.operators import audit, format_check, report, scoring, sections, text_compare
from docaudit.plans import queries

random.seed(3)
ODD = ["  A \t B　C  ", "本系统，支持 AI / 智能校验。", "naïve ß ς ΟΔΟΣ", "", " ", "\x1c x \x1f", "a\nb ", "_a-1_"]


def one(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_normal_forms(spark):
    import re

    texts = ODD + ["".join(random.choice("ab \t　\n\x1c,本。ßé1_") for _ in range(12)) for _ in range(400)]
    assert one(spark, texts, text.normalized) == [re.sub(r"[ \t]+", " ", t.replace("\xa0", " ").replace("　", " ")).strip() for t in texts]
    assert one(spark, texts, text.comparable) == ["".join(re.findall("[一-鿿A-Za-z0-9]", t)).lower() for t in texts]
    assert one(spark, texts, text.folded) == [re.sub(r"[\W_]+", "", t).casefold() for t in texts]
    assert one(spark, ["  A\xa0 B　C  "], text.normalized) == ["A B C"]


def test_ngrams(spark):
    for t, got in zip(["", "a", "abcab", "本系统"], one(spark, ["", "a", "abcab", "本系统"], lambda c: text.ngrams(c, 2, 4)), strict=True):
        assert got == [t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)]
    assert one(spark, ["另一方面，一方面"], lambda c: text.occurrences(c, "一方面")) == [2]


def test_image_expressions(spark):
    rng = np.random.default_rng(0)
    rows = [rng.normal(size=64).tolist() for _ in range(50)]
    hashes = one(spark, rows, lambda c: image.hash_hex(image.hash_bits(c)), "array<double>")
    for row, got in zip(rows, hashes, strict=True):
        middle = sorted(row[1:])[31]
        assert got == f"{int(''.join('1' if x > middle else '0' for x in row), 2):016x}"
    pairs = spark.createDataFrame([(a, b) for a in hashes[:10] for b in hashes[:10]], "a string, b string")
    for r in pairs.select("a", "b", image.hamming(image.hash_of_hex(F.col("a")), image.hash_of_hex(F.col("b"))).alias("d")).collect():
        assert r.d == (int(r.a, 16) ^ int(r.b, 16)).bit_count()
    row = spark.sql("SELECT array(0, 0, 0) a, array(255, 255, 255) b, cast(null as array<int>) n").select(image.colour_similarity(F.col("a"), F.col("b")).alias("far"), image.colour_similarity(F.col("a"), F.col("n")).alias("none"), image.aspect_delta(F.lit(4), F.lit(2), F.lit(1), F.lit(1)).alias("d"), image.aspect_delta(F.lit(0), F.lit(2), F.lit(1), F.lit(1)).alias("z")).first()
    assert abs(row.far) < 1e-12 and row.none == 1 and row.d == 0.5 and row.z == 0


def test_pixels():
    def pattern(n, variant):
        rows, cols = np.mgrid[:n, :n] / n
        a = np.full((n, n, 3), 255, np.uint8)
        a[(rows > 0.2) & (rows < 0.7) & (cols > 0.1) & (cols < 0.5)] = 30
        a[np.abs(rows - cols) < 0.05 if variant == 0 else np.hypot(rows - 0.6, cols - 0.7) < 0.25] = 90
        return a

    distance = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    small, large, other = (pixels.perceptual_hash(pattern(n, v)) for n, v in ((64, 0), (128, 0), (96, 1)))
    assert distance(small, large) <= 15 < distance(small, other) + 10
    assert pixels.mean_rgb(np.full((50, 40, 3), (10, 20, 30), np.uint8)) == [10, 20, 30]
    page = np.full((200, 300, 3), 255, np.uint8)
    rows, cols = np.mgrid[:200, :300]
    page[(np.hypot(rows - 60, cols - 80) < 32) & (np.hypot(rows - 60, cols - 80) > 22)] = (200, 20, 30)
    page[150:154, 60:200] = 10
    found = pixels.detect(page, (40, 130, 220, 50))
    assert found["status"] == "ok" and [c["kind"] for c in found["candidates"]] == ["seal", "signature"]
    assert pixels.detect(None)["status"] == "failed" and pixels.detect(np.full((50, 50, 3), 255, np.uint8))["candidates"] == []


def test_risk(spark):
    levels = one(spark, [0.19, 0.20, 0.40, 0.65, 0.85], scoring.risk_level, "double")
    assert levels == ["minimal", "low", "medium", "high", "critical"]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    given_ = [spark.createDataFrame([(1, k, True, x)], "doc_id long, dimension string, applicable boolean, raw_score double") for k, x in (("text_similarity", 0.60), ("ai_likelihood", 0.30))]
    rows = scoring.risk_dimensions(docs, given_)
    got = {r.doc_id: r for r in scoring.risk_documents(rows).collect()}
    assert got[1].score == 0.518182 and got[2].score == 0 and got[2].risk_level == "minimal"
    assert abs(sum(r.effective_weight for r in rows.where("doc_id = 1").collect()) - 1) < 2e-6


@pytest.mark.parametrize("make", [lambda: config.TextCompare(medium=0.9, high=0.5), lambda: config.TextCompare(ngram_min=3, ngram_max=2), lambda: config.Style(min_chars=5), lambda: config.Scoring(low=0.5, medium=0.4), lambda: config.Annotation(min_severity="x"), lambda: config.ImageCompare(exact_distance=20)])
def test_settings_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_settings_from_yaml(tmp_path):
    (tmp_path / "s.yaml").write_text("text:\n  high: 0.9\n  unknown: 1\n")
    assert config.from_yaml(config.TextCompare, tmp_path / "s.yaml", "text").high == 0.9
    assert config.from_yaml(config.TextCompare, tmp_path / "s.yaml", "none") == config.TextCompare()


def paragraphs(spark, docs):
    rows = [(b, d, f"sha{d}", f"doc-{d}", i, f"p-{i + 1:06d}", t, level) for d, (b, parts) in docs.items() for i, (t, level) in enumerate(parts)]
    return spark.createDataFrame(rows, "batch long, doc_id long, sha256 string, document_id string, ord int, paragraph_id string, text string, heading_level int")


def test_sections(spark):
    rows = sections.section_paths(paragraphs(spark, {1: (0, [("lead", None), ("A", 1), ("p", None), ("B", 2), ("p", None), ("C", 1), ("p", None), ("D", 3), ("q", None)])})).orderBy("ord").collect()
    assert [r.section for r in rows] == ["正文", "A", "A", "A / B", "A / B", "C", "C", "C / D", "C / D"]


SHARED = "本系统采用分层架构设计，支持横向扩展与容灾切换，保障核心业务连续运行和数据安全，满足长期演进要求。"


def test_text_comparison(spark):
    docs = {1: (0, [(SHARED, None), ("甲公司负责平台建设与后续运维保障工作的全部内容安排", None)]), 2: (0, [("乙公司提供硬件设备以及机房改造实施和验收服务等内容", None), (SHARED, None)]), 3: (0, [("标题", 1), ("我方完全响应招标要求，并承诺按合同约定完成全部建设内容和服务", None)]), 4: (0, [("我方完全响应招标要求，并承诺按合同约定完成全部建设内容和服务", None)])}
    prepared = text_compare.prepared(sections.section_paths(paragraphs(spark, docs)), config.TextCompare(min_chars=15))
    assert {(r.doc_id, r.ord): r.weight for r in prepared.collect()} == {(1, 0): 1, (1, 1): 1, (2, 0): 1, (2, 1): 1, (3, 1): 0.7, (4, 0): 0.7}
    found = text_compare.findings(text_compare.scores(prepared), prepared)
    rows = {(r.left_doc, r.right_doc): r for r in found.collect()}
    assert rows[1, 2].severity == "high" and rows[1, 2].score == 1.0 and (rows[1, 2].left_ord, rows[1, 2].right_ord) == (0, 1)
    assert rows[3, 4].severity == "medium" and rows[3, 4].raw_score == 1.0 and rows[3, 4].score == 0.7
    pairs = text_compare.document_pairs(prepared, spark.createDataFrame([(0, d) for d in docs], "batch long, doc_id long"))
    assert pairs.count() == 6 and text_compare.pair_summary(found, pairs).where("high_count > 0").count() == 1
    rates = {(r.left_doc, r.right_doc, r.side): r.repeated_rate for r in text_compare.document_stats(found, prepared, pairs).collect()}
    assert rates[1, 2, "left"] > 0 and rates[3, 4, "left"] == 0
    with pytest.raises(Exception, match="at most 5"):
        text_compare.scores(text_compare.prepared(paragraphs(spark, {d: (0, [(SHARED, None)]) for d in range(6)}))).collect()


def test_pair_scores_equal_a_plain_computation(spark):
    words = ["alpha", "beta", "gamma", "delta", "system", "platform", "network"]
    docs = {d: (0, [(" ".join(random.choice(words) for _ in range(9)), None) for _ in range(4)]) for d in (1, 2)}
    prepared = text_compare.prepared(paragraphs(spark, docs))
    texts = {(r.doc_id, r.ord): r.normalized for r in prepared.collect()}
    grams = lambda t, a, b: [t[i : i + n] for n in range(a, b + 1) for i in range(len(t) - n + 1)]
    total = len(texts)
    idf = lambda g: math.log((1 + total) / (1 + sum(g in t for t in texts.values()))) + 1
    for r in text_compare.scores(prepared).collect():
        a, b = texts[1, r.left_ord], texts[2, r.right_ord]
        va, vb = ({g: grams(t, 2, 4).count(g) * idf(g) for g in set(grams(t, 2, 4))} for t in (a, b))
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        assert abs(r.tfidf_cosine - sum(x * vb.get(g, 0) for g, x in va.items()) / norm(va) / norm(vb)) < 1e-5
        ta, tb = set(grams(a, 3, 3)), set(grams(b, 3, 3))
        assert abs(r.containment - len(ta & tb) / min(len(ta), len(tb))) < 1e-5
        gate = max(r.tfidf_cosine, r.containment) >= 0.35
        assert abs(r.sequence_ratio - (SequenceMatcher(None, a, b, autojunk=False).ratio() if gate else 0)) < 1e-5


def test_large_batches_are_compared_on_arrays():
    """Five documents of 120 paragraphs, 144,000 pairs: some seconds, where a loop over tokens takes minutes; two of them by hand."""
    import time

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(300)]
    texts = ["".join(rng.choice(words) for _ in range(50)) for _ in range(600)]
    ids, ords, s = np.repeat(np.arange(5), 120), np.tile(np.arange(120), 5), config.TextCompare()
    began = time.process_time()
    columns = text_compare._compare(7, ids, ords, texts, np.ones(600), s, False)
    assert time.process_time() - began < 15
    rows = {(a, b, i, j): (shared, rank, jaccard) for _, a, b, i, j, shared, rank, jaccard, *_ in zip(*[c.tolist() for c in columns], strict=True)}
    assert len(rows) == 10 * 120 * 30
    two = [{t[i : i + 2] for i in range(len(t) - 1)} for t in texts]
    for a, b, i in ((0, 1, 5), (2, 4, 119)):
        x = two[120 * a + i]
        best = sorted((-len(x & y) / len(x | y), j) for j, y in enumerate(two[120 * b : 120 * b + 120]))[:30]
        assert [(a, b, i, j) in rows and rows[a, b, i, j][1:] == (k + 1, -v) for k, (v, j) in enumerate(best)] == [True] * 30


def test_ratio_of_copies_needs_no_search(monkeypatch):
    for a, b in (("abcab", "abcab"), ("abcab", "bcaab"), ("a", "b")):
        assert text_compare._ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()
    monkeypatch.setattr(text_compare, "SequenceMatcher", None)
    assert text_compare._ratio("ab" * 3000, "ab" * 3000) == 1.0


def test_ratios_of_many_pairs_are_those_of_sequence_matcher(monkeypatch):
    """Copies, edits, periodic and empty texts, characters beyond 16 bits; also in small portions, where rectangles with many places go to SequenceMatcher."""
    rng = random.Random(11)
    texts = ["", "a", "ab" * 40, "ba" * 41 + "c", "中文投标方案\U00020000技术方案" * 4, "技术方案\U00020000中文投标" * 5]
    for alphabet in ("ab", "abcdefgh", "etaoinshrdlucmf"):
        words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(12)]
        whole = "".join(rng.choice(words) for _ in range(40))
        texts += [whole, whole[9:60] + whole[:30], whole[:50] + "x" + whole[51:], "".join(rng.choice(words) for _ in range(30))]
    i, j = np.divmod(np.arange(len(texts) ** 2), len(texts))
    plain = np.array([SequenceMatcher(None, texts[a], texts[b], autojunk=False).ratio() for a, b in zip(i, j, strict=True)])
    need = np.array([rng.random() for _ in i])
    for points, chars in ((1 << 20, 1 << 17), (60, 500)):
        monkeypatch.setattr(text_compare, "_POINTS", points)
        monkeypatch.setattr(text_compare, "_CHARS", chars)
        assert (text_compare._ratios(texts, i, j, np.zeros(len(i))) == plain).all()
        some = text_compare._ratios(texts, i, j, need)
        assert ((some == plain) | (some == 0))[plain < need].all() and (some == plain)[plain >= need].all()


def test_ratios_of_a_batch_need_no_search_for_each_pair():
    """1,440 pairs of 400 characters: a second or so, where SequenceMatcher takes ten or more."""
    import time

    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshrdlucmf") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    texts = ["".join(rng.choice(words) for _ in range(80)) for _ in range(60)]
    ids, ords, s = np.repeat(np.arange(5), 12), np.tile(np.arange(12), 5), config.TextCompare(sequence_gate=0.0)
    began = time.process_time()
    columns = text_compare._compare(7, ids, ords, texts, np.ones(60), s, True)
    assert time.process_time() - began < 5
    rows = list(zip(*[c.tolist() for c in columns], strict=True))
    assert len(rows) == 10 * 144
    for r in rows[::97]:
        assert r[10] == SequenceMatcher(None, texts[12 * r[1] + r[3]], texts[12 * r[2] + r[4]], autojunk=False).ratio()


def test_scores_of_a_least_with_ratios_are_those_of_all_above_it():
    """Also where the ratio alone lifts a score above it: the same characters with others between them."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(9)]
    texts = ["".join(rng.choice(words) for _ in range(12)) for _ in range(20)]
    texts += ["".join(a + b for a, b in zip(t, "qrstuvwxyz" * 9)) for t in texts[:10]] + texts[5:15]
    ids, ords, weights = np.repeat(np.arange(4), 10), np.tile(np.arange(10), 4), np.tile([1.0, 0.7], 20)
    s = config.TextCompare(sequence_gate=0.0, min_shared=0)
    every = list(zip(*[c.tolist() for c in text_compare._compare(7, ids, ords, texts, weights, s, True)], strict=True))
    kept = lambda rows: [r for r in rows if round(r[-1], 6) >= 0.6]
    some = kept(zip(*[c.tolist() for c in text_compare._compare(7, ids, ords, texts, weights, s, True, 0.6)], strict=True))
    assert some == kept(every) and any(r[10] > max(r[8], r[9]) for r in some)


def test_paragraphs_are_prepared_once(spark):
    plan = text_compare.prepared(paragraphs(spark, {1: (0, [(SHARED, None)])}), responses=("that the ",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("regexp_replace") == 1


def test_scores_of_a_least_are_those_of_all_above_it(spark):
    rng = random.Random(3)
    docs = {d: (d // 3, [(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(8)), None) for _ in range(6)]) for d in range(6)}
    prepared = text_compare.prepared(paragraphs(spark, docs))
    every = text_compare.scores(prepared, sequence=False)
    some = sorted(every.where("score >= 0.6").collect())
    assert 0 < len(some) < every.count()
    assert sorted(text_compare.scores(prepared, sequence=False, least=0.6).collect()) == some
    assert text_compare.scores(prepared, sequence=False, least=2.0).count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_files_are_dealt_out_before_work(spark):
    for make in (queries._paragraphs, queries._files, queries._images):
        assert "RepartitionByExpression" in _plan(make(spark, "/root/testdata/sf0.001"))


def test_bits_of_images_are_computed_once(spark):
    plan = _plan(queries.image_pairs_banded(spark, "/root/testdata/sf0.001"))
    assert plan.count("array_sort") == 2  # once for each side


def _nodes(plan) -> list[str]:
    below = plan.children()
    return [plan.nodeName(), *[n for i in range(below.size()) for n in _nodes(below.apply(i))]]


@pytest.mark.parametrize("name", ["text_doc_stats", "complete_analysis"])
def test_branches_read_kept_steps(spark, name):
    """What several branches read is kept: none prepares paragraphs or compares texts on its own."""
    nodes = _nodes(queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().withCachedData())
    spark.catalog.clearCache()
    assert "InMemoryRelation" in nodes and not {"Window", "MapInArrow", "MapInPandas", "Generate"} & set(nodes) - ({"Generate"} if name == "complete_analysis" else set())


def test_four_grams_and_spaces(spark):
    """Equal to the plain forms, also beyond the basic plane and with odd spaces; usual texts are not taken apart by characters."""
    from docaudit.operators import stylometry

    rows = [*ODD, "abcdefgh", "𝒜𝒷cd𠀀efg", "𠀀" * 5, "a b  c\td\u2003e", "two words", "\u00a0x y", "abc"]
    assert one(spark, rows, lambda x: stylometry._fours(x), "string") == [[t[i : i + 4] for i in range(len(t) - 3)] for t in rows]
    assert one(spark, rows, text.comparable) == ["".join(c for c in t if "一" <= c <= "鿿" or c.isascii() and c.isalnum()).lower() for t in rows]
    got = stylometry.signals(spark.createDataFrame([(t,) for t in rows], "text string"))
    assert [r.chars for r in got.collect()] == [len(" ".join(t.split())) for t in rows]
    assert "regexp_extract_all" in _plan(got)


def test_regions_are_found_by_runs():
    """Region by region, as a flood fill finds them; a noisy page takes no time for each region's whole page."""
    import time

    rng = np.random.default_rng(4)
    for share in (0.1, 0.4, 0.6):
        mask = rng.random((30, 25)) < share
        label, n = pixels._labels(mask)
        seen, regions = set(), 0
        for start in zip(*map(list, np.nonzero(mask)), strict=True):
            if start in seen:
                continue
            regions += 1
            todo, own = [start], set()
            while todo:
                if (at := todo.pop()) not in own and 0 <= at[0] < 30 and 0 <= at[1] < 25 and mask[at]:
                    own.add(at)
                    todo += [(at[0] + i, at[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            assert {label[x] for x in own} == {label[start]} and (label == label[start]).sum() == len(own)
            seen |= own
        assert regions == n and not label[~mask].any()
    page = np.full((600, 800, 3), 255, np.uint8)
    page[10::12, 10::12] = (200, 20, 30)  # 3,300 red dots
    began = time.process_time()
    assert pixels.seal_candidates(page) == []
    assert time.process_time() - began < 1.5


def test_pages_are_dealt_out(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["seal_and_ink_candidates"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_styles(spark):
    runs = [("d", p, i, "Arial", 12.0) for p in range(4) for i in range(2)] + [("d", 4, 0, "Courier New", 18.0), ("e", 0, 0, "X", 10.0), ("e", 0, 1, "Y", 11.0), ("e", 1, 0, None, 10.3), ("f", 0, 0, None, None)]
    signatures = format_check.run_signatures(spark.createDataFrame(runs, "doc_id string, para_id long, run_ord int, font string, size double"))
    first = signatures.where("doc_id = 'e' AND para_id = 0").first()
    assert (first.font, first.size) == ("X", 10.0)  # a tie goes to what is seen first
    dominant = format_check.dominant_styles(signatures)
    assert {r.doc_id: r.dominant_ratio for r in dominant.collect()}["d"] == 0.8
    assert [(r.doc_id, r.para_id) for r in format_check.style_outliers(signatures, dominant).collect()] == [("d", 4)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["created", "running", "failed", "succeeded", "cancelled", "interrupted"])), min_size=1, max_size=8))
def test_transitions_table_is_closed(steps):
    for (s,) in steps:
        assert set(audit.TRANSITIONS[s]) <= set(audit.TRANSITIONS)


def test_chain_shows_tampering(spark):
    rows = [(t, s, "e", None, "actor", f"2026-01-0{s}", '{"a":"é\\n"}') for t in "xy" for s in (1, 2, 3)]
    chain = audit.chained(spark.createDataFrame(rows, "task_id string, sequence long, event_type string, stage string, actor_id string, created_at string, payload_json string"))
    assert all(r.valid for r in audit.verified(chain).collect())
    import hashlib
    import json

    first = chain.where("task_id = 'x' AND sequence = 1").first().asDict()
    body = {k: first[k] for k in audit.FIELDS}
    assert first["previous_event_hash"] == "0" * 64
    assert hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest() == first["event_hash"]
    edited = chain.withColumn("payload_json", F.when((F.col("task_id") == "x") & (F.col("sequence") == 2), "{}").otherwise(F.col("payload_json")))
    assert {r.task_id: (r.valid, r.first_bad) for r in audit.verified(edited).collect()} == {"x": (False, 2), "y": (True, None)}
    assert {r.task_id: r.valid for r in audit.verified(chain.where("NOT (task_id = 'y' AND sequence = 2)")).collect()} == {"x": True, "y": False}


def test_report_order_and_default_action(spark):
    rows = [(0, "b", "ai_likelihood", "medium", 0.6, "d", None), (0, "a", "text_similarity", "high", 0.9, "d", "e"), (0, "c", "text_similarity", "medium", 0.9, "d", "e")]
    findings = spark.createDataFrame(rows, "batch long, finding_id string, type string, severity string, score double, document_id string, peer_document_id string")
    assert [r.finding_id for r in report.report_findings(findings).orderBy("rank").collect()] == ["a", "c", "b"]
    actions = report.report_actions(findings, spark.createDataFrame([(0,), (7,)], "batch long")).orderBy("batch", "position").collect()
    assert [(a.batch, a.priority, a.related_finding_ids) for a in actions] == [(0, "high", ["a", "c"]), (0, "normal", ["b"]), (7, "normal", [])]
