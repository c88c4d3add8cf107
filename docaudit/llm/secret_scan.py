"""Secrets in whole texts: three patterns, and values in a credential's place whose guess cost is high.

The guess cost of a value is the cheapest way to spell it as common words, dates, repeats, keyboard walks and spans of
brute force, found by dynamic programming over its positions, in powers of ten. Time and memory are linear in its length.

Defined results: null text counts as empty; a text without spans has counts of 0, the digest of the empty string and an
empty span list; rows with one doc_id each have a row; other columns are ignored. Offsets are code points, end exclusive.
Spans of different kinds may overlap; of equal starts the order is assign, access, hex, cost. Texts and values are taken
whole, however long.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_store import _arrow

ROWS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, max_cost double"
#: Powers of ten of guesses from which a value in a credential's place counts as a secret.
LEAST_COST = 8.0
#: A further segment costs the guesser this many powers of ten, for the ways to arrange segments.
SEGMENT = 0.6

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HEX_SAMPLE = re.compile(r"[0-9a-f]{8}")
#: Key words of a credential, and what may stand before "key" and "token"; the pattern and the hints are made of them.
KEY_WORDS = ("password", "passwd", "passphrase", "passcode", "pass", "pwd", "secret", "token", "credentials", "credential", "authorization")
KEY_OF = ("api", "access", "private", "auth", "secret")
#: A key word begins a word, or a part of a camel-case one (dbPassword, DBPassword).
_CONTEXT = re.compile(
    r"(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))(?:" + "|".join(KEY_WORDS) + "|(?:" + "|".join(KEY_OF) + r")[_-]?(?:key|token))"
    r"""["']?\s{0,3}(?:=>|:=|[:=])\s{0,3}(?:bearer\s+)?["']?([^\s"'<>,;]+)""",
    re.I | re.A,
)
#: A text that the pattern matches holds one of these.
_HINTS = tuple(w for w in (*KEY_WORDS, *(k + c + "key" for k in KEY_OF for c in ("", "_", "-"))) if not any(x in w for x in KEY_WORDS if x != w))
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that guessers try first, most frequent first.
COMMON_WORDS = (
    "password 123456 qwerty admin welcome letmein login master dragon monkey shadow sunshine princess football baseball "
    "superman batman hello freedom whatever trustno1 secret test guest root user changeme default example sample demo "
    "temp pass word love summer winter spring autumn monday friday january march april june july august december house "
    "computer internet server service system network database account access token private public key value string "
    "null none true false your here enter insert replace todo placeholder xxxx the and for you with this that from have"
).split()
_RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
_LEET = str.maketrans("4@3!105$7", "aaeiioss" + "t")
_KEYS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEAR = {c: {b for r2, other in enumerate(_KEYS) for j, b in enumerate(other) if abs(r2 - r) + abs(j - i) <= 1 or (r2 == r + 1 and j == i - 1) or (r2 == r - 1 and j == i + 1)} - {c} for r, row in enumerate(_KEYS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\3(?:19|20)\d\d))")
_YEAR = re.compile(r"(?=((?:19|20)\d\d))")
_REPEAT = re.compile(r"(.{1,4}?)\1{2,}")


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


@lru_cache(maxsize=1)
def _words():
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in COMMON_WORDS:
        if len(w) >= 3:
            out.add_word(w, len(w))
    out.make_automaton()
    return out


def segments(value: str) -> Iterator[tuple[int, int, float, str]]:
    """(start, end, cost, kind) of the spans that are cheaper than brute force might be."""
    low = value.lower() if value.isascii() else "".join(c.lower() if c.isascii() else c for c in value)
    plain = low.translate(_LEET)
    for text, extra in ((low, 0.0), (plain, 0.5)) if plain != low else ((low, 0.0),):
        for last, length in _words().iter(text):
            i, j = last + 1 - length, last + 1
            if extra and low[i:j] in _RANK:
                continue
            capitals = sum(c.isupper() for c in value[i:j])
            yield i, j, math.log10(_RANK[text[i:j]] + 1) + extra + (0.3 if capitals in (1, j - i) else math.log10(math.comb(j - i, capitals)) if capitals else 0.0), "word"
    for m in _DATE.finditer(value):
        yield m.start(), m.start() + len(m[1]), math.log10(365 * 120) + 0.3 * bool(m[2] or m[3]), "date"
    for m in _YEAR.finditer(value):
        yield m.start(), m.start() + 4, math.log10(120), "date"
    for m in _REPEAT.finditer(value):
        yield m.start(), m.end(), sum(map(_alphabet, m[1])) + math.log10((m.end() - m.start()) // len(m[1])), "repeat"
    i = 0
    while i < len(low):
        j, turns, step = i + 1, 0, None
        while j < len(low) and (low[j] in _NEAR.get(low[j - 1], ()) or ord(low[j]) - ord(low[j - 1]) == 1 and low[j].isascii() and low[j].isalnum()):
            now = ord(low[j]) - ord(low[j - 1])
            turns += step is not None and now != step and low[j] not in _NEAR.get(low[j - 1], ())
            step, j = now, j + 1
        if j - i >= 4:
            yield i, j, math.log10(47) + math.log10(j - i) + 0.6 * (turns + 1), "walk"
        i = max(i + 1, j - 1)


def guess_cost(value: str) -> float:
    """Powers of ten of guesses that the cheapest segmentation needs."""
    n = len(value)
    arriving: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost, _ in segments(value):
        arriving.setdefault(end, []).append((start, cost))
    closed, brute = array("d", bytes(8 * (n + 1))), math.inf  # the cheapest spelling of value[:i] in any way; that ends in brute force
    for i, c in enumerate(value, 1):
        step = _alphabet(c)
        brute = min(brute + step, closed[i - 1] + step + (SEGMENT if i > 1 else 0.0))
        best = brute
        for s, cost in arriving.get(i, ()):
            best = min(best, closed[s] + cost + (SEGMENT if s else 0.0))
        closed[i] = best
    return closed[n]


_ORDER = {"assign": 0, "access": 1, "hex": 2, "cost": 3}


def scan(text: str) -> tuple[list[tuple[str, int, int]], float]:
    """All spans (kind, start, end) of a text in order, and the highest guess cost of a value in a credential's place."""
    spans, low, most = [], text.lower(), 0.0
    if any(h in low for h in _ASSIGN_HINTS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    # a run of 32 has eight of every fourth code points
    if _HEX_SAMPLE.search(text[::4]):
        spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if any(h in low for h in _HINTS):
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".!?)]}:")
            cost = guess_cost(value)
            most = max(most, cost)
            if cost >= LEAST_COST:
                spans.append(("cost", m.start(1), m.start(1) + len(value)))
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2])), most


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            spans, most = scan(text) if text else ([], 0.0)
            counts = [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
            base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "cost")
            rows.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest() if base else none, ",".join(f"{k}:{a}:{b}" for k, a, b in spans), most))
        schema = _arrow(ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema, strict=True)], schema=schema)


def scan_documents(documents: DataFrame) -> DataFrame:
    """Span counts, their digest and the spans of documents(doc_id, text)."""
    common.arrow_limits(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan_batches, ROWS)

