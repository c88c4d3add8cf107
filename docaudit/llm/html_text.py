"""Main text of HTML pages by maximum-scoring subsequence.

A page is a sequence of words and tags. A word's score is the log odds, learned from labelled pages, that words whose
enclosing elements have such names, classes and roles belong to an article. Where these tell nothing (plain divisions,
tables, any language), it is the log odds of its block's structure: its length, the share of words in links, its element.
A tag's score is negative, by how much more often it stands outside of articles. One linear scan finds the contiguous region
of the highest total; of its words, those inside elements that are never part of an article (an advert or a form amid it)
are left out, short or linked ones are not.

Defined results: null html counts as empty; a page without a word of positive score has an empty text; rows with one
page_id each have a row; of regions of equal totals the first counts; an unclosed element ends with the element around it;
texts are taken whole, however long; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_store import _arrow

ROWS = "page_id long, url string, text string, n_chars long"

#: Fixed values of HTML: elements whose content is not text, elements without content, and elements inside a block.
RAW = ("noscript", "template", "textarea", "iframe", "svg", "title", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of the key closes an open element of the value's names.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {
    t: {"p"} for t in "address article aside blockquote details div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<code>script|style)\b[^>]*>.*?(?:</(?P=code)\s*>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?</(?P=raw)\s*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([\w-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_NAME_PART = re.compile(r"[a-z]+")
#: How far an element's own features may move a word's score, and what a word scores without any.
BOUND, WORD = 6.0, 1.0
#: The most that one stretch of text in an element outside of articles counts against a region that goes on behind it.
NODE = 1.5


def features(name: str, attrs: str) -> tuple[str, ...]:
    """Names that an element adds to the context of its words."""
    out = [f"<{name}"]
    if name not in ("html", "body") and attrs and not attrs.isspace():  # a whole page's classes say nothing
        for key, a, b, c in _ATTRIBUTE.findall(attrs):
            key = key.lower()
            if key in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
                out += [f".{x}" for x in _NAME_PART.findall((a or b or c).lower())]
            elif key in ("hidden", "aria-hidden") and (a or b or c).lower() != "false":
                out.append(".hidden")
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a or b or c, re.I):
                out.append(".hidden")
    return tuple(dict.fromkeys(out))


def walk(page: str, score) -> Iterator[tuple[str, object, float | None, bool]]:
    """('text', words as written, score of a word, whether in a link), ('tag', name, ...) and ('break', name, ...) in page order.

    score(features) is an element's own part; a word's score is the lowest that its elements' parts lead to, None if they tell
    nothing.
    """
    stack: list[tuple[str, float, float, bool]] = []  # name, lowest part, sum of parts above zero, in a link
    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            _, low, high, link = stack[-1] if stack else ("", 0.0, 0.0, False)
            yield "text", text, low if low < 0 else WORD + min(high, BOUND) if high > 0 else None, link
        elif m["name"]:
            name = m["name"].lower()
            yield "tag" if name in INLINE else "break", name, 0.0, False
            if m["close"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                continue
            if shut := CLOSES.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in shut:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            if name in VOID or m["attrs"].endswith("/") and name not in INLINE and name in ("br", "hr", "img"):
                continue
            part = score(features(name, m["attrs"]))
            _, low, high, link = stack[-1] if stack else ("", 0.0, 0.0, False)
            stack.append((name, min(low, part), high + max(part, 0.0), link or name == "a"))
        elif m["raw"] or m["code"]:
            yield "break", (m["raw"] or m["code"]).lower(), 0.0, False


# --- structure: blocks of labelled pages that a seeded generator lays out in plain divisions and tables

#: Most words of a block's length class, and the elements that are told apart.
LENGTHS, KINDS = (2, 5, 10, 20, 40), ("p", "li", "td", "h1", "h2", "h3", "h4")


def structure(kind: str, words: int, linked: int) -> tuple[str, int, int]:
    """What is known of a block by its structure."""
    return kind if kind in KINDS else "", sum(words > x for x in LENGTHS), 0 if not linked else 1 if 2 * linked <= words else 2


def _plain_page(rng: Random) -> list[tuple[bool, str, int, int]]:
    """Blocks (of the article or not, element, words, words in links) of a page without telling names."""
    box = rng.choice(("", "td", "li", "p"))
    links = lambda n: [(False, rng.choice((box, "li", "")), k := rng.randint(1, 4), k) for _ in range(n)]
    page = [(False, rng.choice(("", "h1", "h2", "td")), rng.randint(1, 5), 0)] + (links(rng.randint(3, 9)) if rng.random() < 0.7 else [(False, box, k := rng.randint(4, 12), rng.choice((0, k)))])
    page += [(False, rng.choice(("", "p")), rng.randint(5, 14), rng.choice((0, 0, 1)))] * (rng.random() < 0.5)
    page.append((True, rng.choice(("h1", "h1", "h2", "")), rng.randint(3, 14), 0))
    for _ in range(rng.randint(3, 14)):
        draw = rng.random()
        if draw < 0.1:
            page.append((True, rng.choice(("h2", "h3", "h4")), rng.randint(1, 9), 0))
        elif draw < 0.2:
            page += [(True, "li", n := rng.randint(3, 25), rng.choice((0, 0, n // 3))) for _ in range(rng.randint(2, 5))]
        else:
            n = rng.randint(12, 130) if draw < 0.75 else rng.randint(2, 12)
            page.append((True, rng.choice(("p", "p", "", "td")), n, rng.choice((0, 0, 0, min(n // 4, 3)))))
    for _ in range(rng.choice((0, 0, 0, 2, 5))):  # comments: who and when, a few words, an answer link
        page += [(False, "", rng.randint(2, 4), rng.choice((0, 1))), (False, rng.choice(("p", "")), rng.randint(3, 30), 0), (False, "", k := rng.randint(1, 2), k)]
    if rng.random() < 0.6:
        page += [(False, rng.choice(("h3", "h4", "")), rng.randint(1, 3), 0), *links(rng.randint(3, 8))]
    page.append((False, rng.choice(("", "p", "td")), k := rng.randint(4, 12), rng.choice((0, 0, k // 2, k))))
    return page


@lru_cache(maxsize=1)
def learned_structure() -> dict[tuple[str, int, int], float]:
    """Log odds, by words, of blocks of each structure on the generated pages."""
    rng, counts = Random(5), {}
    for _ in range(600):
        for own, kind, words, linked in _plain_page(rng):
            for key in {structure(kind, words, linked), (None, *structure(kind, words, linked)[1:])}:
                counts.setdefault(key, [1.0, 1.0])[not own] += 1
    return {key: max(-2.0, min(2.0, math.log(inside / outside))) for key, (inside, outside) in counts.items()}


def block_score(kind: str, words: int, linked: int) -> float:
    key = structure(kind, words, linked)
    odds = learned_structure()
    return odds.get(key, odds.get((None, *key[1:]), 0.0))


# Labelled pages: what <content> holds is the article, all else is not. They are written for this purpose, in the manner of common page builders.
LABELLED = (
    "<body><nav class='menu main-nav'><ul><li><a>w w</a></li><li><a>w</a></li></ul></nav><article><content><h1>w w w</h1><p>w w w w w w <b>w</b> w w</p><p>w w w w w w w w</p></content></article><footer>w w w</footer></body>",
    "<body><header class='site-header masthead'><a class='logo'>w</a> w w</header><main><content><h2>w w</h2><h3>w w w</h3><p>w w w w w w <a>w</a> w w w</p><ul><li>w w w w w</li><li>w w w</li></ul><p>w w w w w w</p></content></main><aside class='sidebar widget'><h3>w</h3><p>w w w w</p></aside><footer class='footer copyright'><p>w w w</p></footer></body>",
    "<body><div class='cookie consent banner notice'><p>w w w w w w</p><button>w</button></div><div class='nav navbar navigation breadcrumb'><a>w</a><a>w</a></div><div class='post entry content'><content><h1>w w</h1><div class='body text'><p>w w w w w w w</p><blockquote>w w w w w</blockquote></div></content></div><div class='comments comment' id='disqus'><p>w w w w w</p><p>w w w w</p></div></body>",
    "<body><div id='header'><h1>w w</h1></div><div id='sidebar'><ul class='links'><li><a>w w</a></li><li><a>w</a></li></ul></div><div id='main' role='main'><content><p>w w w w w w w</p><table><tr><td>w w w</td><td>w w</td></tr></table><pre>w w w w</pre><p>w w w</p></content></div><div id='footer'>w w w</div></body>",
    "<body><div class='ad ads advert advertisement adsense sponsored promo'>w w w w w</div><section class='article story'><content><h1>w w w</h1><p class='lead'>w w w w w</p><p>w w w w w w</p><figure><figcaption class='caption'>w w w</figcaption></figure></content></section><section class='related recommended teaser'><h3>w</h3><a>w w w</a><a>w w w</a></section><form class='newsletter subscribe signup'><label>w w</label><input><button>w</button></form></body>",
    "<body><div role='banner'>w w</div><div role='navigation'><a>w</a></div><div role='main' itemprop='articlebody'><content><h1>w w</h1><p>w w w w w w</p><h2>w w</h2><p>w w w w w w w</p><ol><li>w w w</li></ol></content></div><div role='complementary'><p>w w w</p></div><div role='contentinfo'><p>w w</p></div><form role='search'><label>w</label><select></select></form></body>",
    "<body><div class='alert warning notification popup modal overlay gdpr'><p>w w w w</p></div><div class='topbar toolbar'><a>w</a></div><div class='page article-content'><content><h1>w w</h1><p>w w w w w w w w</p><p>w w w</p></content><div class='share social sharing tags'><a>w</a><a>w</a></div><div class='pagination pager'><a>w</a></div></div><div class='hidden'>w w w</div><div class='replies responses reviews discussion' id='respond'><p>w w w w</p></div></body>",
    "<body><table><tr><td><a>w w</a></td><td>w w w</td></tr><tr><td><a>w</a><br><a>w w</a><br><a>w</a></td><td><content><p>w w w w w w w</p><p>w w w w w</p></content></td></tr><tr><td>w w w w</td></tr></table></body>",
    "<body><header><nav><a>w</a></nav></header><dialog>w w w</dialog><article><content><h1>w w</h1><p>w w w w w w</p><dl><dt>w</dt><dd>w w w w</dd></dl></content><aside class='ad'>w w w w</aside><content><p>w w w w w</p></content></article><menu><li>w</li></menu><footer><p>w w</p><ul><li><a>w</a></li></ul></footer></body>",
)
#: Count added to both sides, and log odds from which a feature of both tells.
PRIOR, TELLING = 0.5, 1.5


@lru_cache(maxsize=1)
def learned() -> tuple[dict[str, float], dict[str, float]]:
    """(log odds of an element's feature, negative score of a tag) from the labelled pages."""
    words: dict[str, Counter] = {"in": Counter(), "out": Counter()}
    tags: dict[str, Counter] = {"in": Counter(), "out": Counter()}
    for page in LABELLED:
        side, stack = "out", []
        for m in _TOKEN.finditer(page):
            if m["text"] is not None:
                n = len(m["text"].split())
                for own in {x for _, f in stack for x in f}:
                    words[side][own] += n
            elif m["name"]:
                name = m["name"].lower()
                if name == "content":
                    side = "out" if m["close"] else "in"
                elif m["close"]:
                    while stack and stack.pop()[0] != name:
                        pass
                else:
                    tags[side][name] += 1
                    if name not in VOID:
                        stack.append((name, features(name, m["attrs"])))
    odds = {}
    for f in {*words["in"], *words["out"]}:
        odds[f] = math.log((words["in"][f] + PRIOR) / (words["out"][f] + PRIOR))
    # what holds text on both sides says little, unless nearly all of it is the article's
    for f in [f for f in odds if words["in"][f] and words["out"][f] and odds[f] < TELLING]:
        odds[f] = 0.0
    both = {t: tags["out"][t] + PRIOR for t in {*tags["in"], *tags["out"]}}
    cost = {t: -0.05 - 0.3 * both[t] / (both[t] + tags["in"][t] + PRIOR) for t in both}
    return odds, cost


def _element_score(own: tuple[str, ...]) -> float:
    odds, _ = learned()
    known = [odds[f] for f in own if f in odds]
    lowest = min(known, default=0.0)
    return lowest if lowest < 0 else max(known, default=0.0) / 8


_element_score = lru_cache(maxsize=4096)(_element_score)


def best_region(gains: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous region of the highest positive total, of equal ones the first; (0, 0) if there is none."""
    best, span, run, begin = 0.0, (0, 0), 0.0, 0
    for i, gain in enumerate(gains):
        if run <= 0:
            run, begin = 0.0, i
        run += gain
        if run > best:
            best, span = run, (begin, i + 1)
    return span


def main_text(page: str | None) -> str:
    """The article's blocks, white space inside each made single, joined by one space."""
    if not page:
        return ""
    _, cost = learned()
    parts: list[tuple[str, bool]] = []  # text, or white space at a break, and whether it may be part of an article
    gains: list[float] = []
    block: list[tuple[int, int, bool]] = []  # places of words that only their block's structure tells of: place, words, in a link
    kind = ""

    def close_block() -> None:
        if block:
            words = sum(n for _, n, _ in block)
            each = block_score(kind, words, sum(n for _, n, link in block if link)) if words else 0.0
            for place, n, _ in block:
                gains[place] = n * each
            block.clear()

    for what, value, each, link in walk(page, _element_score):
        if what == "text":
            n = len(value.split())
            if each is None:
                block.append((len(parts), n, link))
                gains.append(0.0)
            else:
                gains.append(max(n * each, -NODE))  # a long advert does not part an article
            parts.append((value, each is None or each >= 0))
        else:
            if what == "break":
                close_block()
                kind = value
            gains.append(cost.get(value, -0.2))
            parts.append((" " if what == "break" else "", True))
    close_block()
    begin, end = best_region(gains)
    text = "".join(value if own else " " for value, own in parts[begin:end])
    return " ".join(entities.unescape(text).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_arrow(ROWS))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length of pages(page_id, url, html)."""
    common.arrow_limits(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract, ROWS)
