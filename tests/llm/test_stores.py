"""Archives, token files, packing and media against brute force on small tables with awkward rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from docaudit.llm import media, packing, token_store, tokens, warc
from docaudit.llm.common import new_folder

random.seed(7)
LONG = " ".join(random.choice("the of and tion ing er".split()) + random.choice("xyz") for _ in range(30_000))
TEXTS = ["plain words here", None, "", "a\tb  c\n\n d ", "It's 12 o'clock — naïve Ünïcode", "日本語 テスト", LONG, "plain words here", "é ́a  İΣ"]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(3 * i, t, "clash", "x") for i, t in enumerate(TEXTS)] + [(3, "repeated id", "clash", "x"), (3, "repeated id", "clash", "x"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, offset string").repartition(3)


def ids_of(name, text, end):
    return np.array([*tokens.memo(tokens.vocabulary(name)).tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memo_gives_the_tokenizers_ids(name):
    memo = tokens.memo(tokens.vocabulary(name))
    texts = [t or "" for t in TEXTS] + ["".join(random.choice("ab 'séT.\n\t1_<|>") for _ in range(50)) for _ in range(2000)]
    for t in texts:
        assert memo.ids(t) == memo.plain(t), t[:60]


def test_memo_cuts_long_texts_alike(monkeypatch):
    monkeypatch.setattr(tokens, "STEP", 500)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        memo = tokens.memo(tokens.vocabulary(name))
        assert len(list(memo.steps(LONG))) > 10
        assert memo.ids(LONG) == memo.plain(LONG)


def test_token_files(spark, documents):
    path = tokens.vocabulary("word_bpe_49k.json")
    files = token_store.write_token_files(documents, new_folder(spark, "t"), path, 2)
    got = sorted(map(tuple, token_store.read_token_files(spark, files).collect()), key=lambda r: r[1])
    expected, start = [], 0
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in rows]
    for r in got:
        assert r[1] == start
        start += r[2]
        expected.append((r[0], r[2], r[3]))
    brute = [(d, len(i := ids_of("word_bpe_49k.json", t, 2)), zlib.crc32(i)) for d, t in rows]
    key = lambda r: (r[0] is not None, r)
    assert sorted(expected, key=key) == sorted(brute, key=key)
    first = token_store.TokenFile(files[0][0])
    assert len(first.document(0)) == first.bounds.select(1)


def test_elias_fano_select():
    for n in (0, 1, 255, 256, 257, 4000):
        values = np.cumsum(np.random.default_rng(n).integers(0, 700, n + 1))
        values[n // 2 :] += 10**7
        ef = token_store.EliasFano.frombytes(token_store.EliasFano.of(values).tobytes())
        assert (ef.range(0, n + 1) == values).all()
        assert all(ef.select(i) == values[i] for i in range(0, n + 1, 13))
    assert 8 * len(ef.tobytes()) / n < 20


def test_packing(spark, documents):
    path = tokens.vocabulary("byte_bpe_50k.json")
    rows = packing.pack_documents(documents, path, 0, 256).collect()
    windows, whole = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 256
    for d, t in {(r.doc_id, r.text) for r in documents.collect()}:
        ids, at = ids_of("byte_bpe_50k.json", t, 0), 0
        for start, n, crc in sorted(set(whole[d, len(ids)])):
            assert start == at and crc == zlib.crc32(ids[start : start + n])
            at += n
        assert at == len(ids)


def test_differencing_is_near_equal_and_keeps_capacity():
    sizes = [random.randrange(1, 257) for _ in range(500)]
    sums = [sum(sizes[i] for i in s) for s in packing.difference(sizes, 60)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 16
    sets = packing.pack([700, 700, 700], 1024)
    assert sorted(map(len, sets)) == [1, 1, 1]  # two windows would hold the sum, none holds two of them
    assert packing.pack([], 10) == []


def test_media(spark, documents):
    rows = media.media_rows(documents, new_folder(spark, "m")).collect()
    assert len(rows) == documents.count()
    texts = {}
    for r in documents.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    for r in rows:
        found = [p for t in texts[r.doc_id] if hashlib.sha256(p := media.padded(t.encode())).hexdigest() == r.payload_sha256]
        assert found and r.payload_bytes == len(found[0]) and r.payload_bytes % 192 == 0 and r.tail_crc32 == zlib.crc32(found[0][-16:])
        assert r.media_sha256 == hashlib.sha256(media.encode(found[0])).hexdigest()
        assert r.feature.startswith(f"png/64x{r.payload_bytes // 192}/")


def test_media_headers_need_33_bytes(spark, documents):
    addresses = media.store(documents, new_folder(spark, "m"))
    assert {r.payload_bytes for r in media.read_media(addresses, full=False).collect()} == {len(media.padded((t or "").encode())) for t in [*TEXTS, "repeated id", "no id"]}
    payload = bytes(range(192)) * 3
    assert media.decode(media.encode(payload)) == payload
    assert media.header(media.encode(payload)[:33]) == (64, 3, 8, 2)


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, monkeypatch, least):
    big = "é" * 400_000
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "ü", big), (6, "ü", big), (None, "n", "same"), (7, "u", "one"), (8, "u", "a\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    manifest = warc.write_archives(pages, new_folder(spark, "w"), least)
    chunks = warc.read_chunks(spark, manifest).collect()
    got = sorted([(r.page_id, r.total_bytes, r.digest_so_far, r.record_type, r.refers_to) for r in chunks if r.last], key=str)
    expected = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        latest = max(same) if len(data) >= least else page_id
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((page_id, len(data), digest, "response" if page_id == latest else "revisit", None if page_id == latest else latest))
    assert got == sorted(expected, key=str)
    whole = {}
    for r in sorted((r for r in chunks if r.record_type == "response"), key=lambda r: r.chunk_no):
        whole.setdefault(r.page_id, {})[r.chunk_no] = bytes(r.chunk)  # the repeated row has equal chunks
    assert max(map(len, (c for x in whole.values() for c in x.values()))) <= warc.CHUNK
    assert b"".join(whole[6].values()) == big.encode() and len(whole[6]) > 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = tokens.vocabulary("word_bpe_49k.json")
    assert token_store.read_token_files(spark, token_store.write_token_files(none, new_folder(spark, "t"), path, 2)).count() == 0
    assert packing.pack_documents(none, path).count() == 0
    assert media.media_rows(none, new_folder(spark, "m")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_chunks(spark, warc.write_archives(pages, new_folder(spark, "w"))).count() == 0
