"""Main text of web pages: the maximum-scoring stretch of a page's words and tags.

A page is read as a line of words and tags. Each kind of word and tag has a weight, and a linear scan finds the contiguous
stretch with the largest sum, which is the content region. The weights are log-odds of lying inside the article, counted over
all labelled pages: those whose markup names one stretch as the article. They score every page; a token inside an article or
main element gets one more weight, the log-odds of the labelled pages' tokens. Boxes that are never article text (menus, footers,
forms, adverts, notices, reader comments, scripts and so on, by tag, role or class) count as one token and are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pieces

#: The elements of HTML by their part in a page.
RAW = ("script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "math", "object", "select", "canvas", "audio", "video")
BOXES = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "datalist", "search"}
ARTICLE = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "search",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
BOX_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
BOX_NAMES = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "respond", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>|"
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[^a-z]+")

#: Limits and first guesses of the weights; counts move them.
WORD, LINK, TAG, BOX = "word", "link", "tag:", "box"
GUESS = {WORD: 0.5, LINK: -0.5, BOX: -2.0}
GUESS_TAG, GUESS_BLOCK_TEXT, GUESS_INSIDE = -1.0, 0.0, 1.0
_TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption"}
LEAST, MOST, PRIOR = -4.0, 1.0, 50.0


SURE, MAYBE, LESS = 3, 2, 1


def _box(name: str, attributes: str, inside: bool) -> int:
    """SURE: never content. MAYBE: a form, or named as a box; what it holds decides. LESS: a box is named after other parts of a name."""
    if name in BOXES and name != "form" or (name == "header" and not inside):
        return SURE
    found = MAYBE if name == "form" else 0
    for key, value in _NAMES.findall(attributes) if attributes else ():
        words = value.strip("\"'").lower()
        if key.lower() == "role":
            if words in BOX_ROLES:
                found = MAYBE if words == "form" else SURE
        elif name not in ("html", "body", *ARTICLE) or "comment" in words:
            for one in words.split():
                parts = [x for x in _PARTS.split(one) if x]
                if not BOX_NAMES.isdisjoint(parts):
                    found = max(found, MAYBE if parts[0] in BOX_NAMES else LESS)
        if found == SURE:
            break
    return found


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """The page as (kind, text, inside the article) in order: kinds are `word` and `link` for runs of text, `tag:NAME`, `box`.

    Text in boxes is not returned. A box ends with its own end tag, or with that of an element around it. A form or an element
    that is named as a box is none if it holds a top heading or an article, or most of the page's words where no article lies
    outside it (unless it is named after comments); its `box` token then only lowers the score where it begins.
    """
    out: list[tuple[str, str, bool]] = []
    stack: list[str] = []  # open elements other than inline ones
    begun: list[int] = []  # for each of them, its number in maybe or -1
    maybe: list[list] = []  # of elements that may be boxes: first token after theirs, end, whether they are named after comments
    box = 0  # depth of the stack at which the box began, plus one
    inside = links = at = 0

    def text(until: int) -> None:
        if until > at and not box and (run := page[at:until]) and not run.isspace():
            out.append((LINK if links else WORD, html.unescape(run), inside > 0))
        elif until > at and not box:
            out.append((TAG, " ", inside > 0))

    def push(name: str, kind: int, attributes: str) -> None:
        nonlocal box, links
        stack.append(name)
        begun.append(-1)
        if kind:
            out.append((BOX, "", inside > 0))
        if kind > LESS:
            links = 0
        if kind == SURE:
            box = len(stack)
        elif kind == MAYBE:
            begun[-1] = len(maybe)
            maybe.append([len(out), -1, any(x in attributes.lower() for x in ("comment", "disqus", "respond"))])

    def pop() -> str:
        nonlocal box, inside
        name = stack.pop()
        if (k := begun.pop()) >= 0:
            maybe[k][1] = len(out)
        if box > len(stack):
            box = 0
        elif not box:
            inside -= name in ARTICLE
        return name

    for m in _TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        if (name := m[3]) is None:
            if m[0].startswith("<!--") or m[1] is None:
                continue
            if not box:
                out.append((BOX, "", inside > 0))
            continue
        name, closing = name.lower(), m[2] == "/"
        if name in INLINE:
            if not closing and not box and name != "a" and m[4] and (kind := _box(name, m[4], inside > 0)) > LESS:
                push(name, kind, m[4])
                continue
            if closing and stack and stack[-1] == name and (box == len(stack) or begun[-1] >= 0):
                pop()
                continue
            if name == "a":
                links = 0 if closing else 1
            continue
        if name in VOID:
            if not box:
                out.append((TAG + name, " " if name != "hr" else "", inside > 0))
            continue
        if closing:
            if name in stack:
                while stack and pop() != name:
                    pass
            links = 0
            if not box:
                out.append((TAG + "/" + name, "", inside > 0))
            continue
        if name == "p" and stack and stack[-1] == "p" or name in ("li", "td", "th", "tr", "dt", "dd") and stack and stack[-1] == name:
            pop()  # their end tags may be missing
        kind = 0 if box else _box(name, m[4], inside > 0)
        push(name, kind, m[4])
        if not box:
            inside += name in ARTICLE
            if kind < MAYBE:
                out.append((TAG + name, "", inside > 0))
    text(len(page))
    return _without_boxes(out, maybe) if maybe else out


def _without_boxes(line: list[tuple[str, str, bool]], maybe: list[list]) -> list[tuple[str, str, bool]]:
    """The line without what lies in those of the elements [start, end) that are boxes."""
    words, main, named = [0], [0], [0]  # sums before each token
    for kind, text, _ in line:
        words.append(words[-1] + (len(text.split()) if kind in (WORD, LINK) else 0))
        named.append(named[-1] + (kind in (TAG + "article", TAG + "main")))
        main.append(main[-1] + (kind in (TAG + "h1", TAG + "article", TAG + "main")))
    out, at = [], 0
    for start, end, comments in maybe:
        end = len(line) if end < 0 else end
        if start < at or not comments and (main[end] > main[start] or not named[-1] and 2 * (words[end] - words[start]) > words[-1]):
            continue
        out += line[at:start]
        at = end
    return out + line[at:]


def count(pages: DataFrame) -> Counter:
    """Over all pages with one named article: how often each kind of token lies inside and outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in pieces(batches, "html"):
            for page in column(batch, "html"):
                line = tokens(page or "")
                if sum(kind in (TAG + "article", TAG + "main") for kind, _, _ in line) != 1:
                    continue
                for kind, text, inside in line:
                    if kind == TAG:
                        continue
                    known = kind if kind in (WORD, LINK, BOX) or kind[4:].lstrip("/") in BLOCKS | VOID else TAG + "other"
                    found[known, inside] += len(text.split()) if kind in (WORD, LINK) else 1
        if found:
            kinds, inside = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(inside), pa.array(found.values(), pa.int64())], ["kind", "inside", "n"])

    rows = pages.select("html").mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return Counter({(r.kind, r.inside): r.n for r in rows})


class Weights:
    """Weights of all kinds of tokens from their counts inside and outside of named articles."""

    def __init__(self, counts: Counter):
        total = {side: sum(n for (_, s), n in counts.items() if s is side) + 1 for side in (True, False)}
        self.of: dict[str, float] = {}
        for kind in {k for k, _ in counts}:
            a, b = counts[kind, True], counts[kind, False]
            odds = math.log((a + 1) / total[True]) - math.log((b + 1) / total[False])
            trust = (a + b) / (a + b + PRIOR)
            self.of[kind] = min(max(trust * odds + (1 - trust) * self.guess(kind), LEAST), MOST)
        a, b = total[True], total[False]
        trust = (a + b) / (a + b + PRIOR)
        self.inside = min(max(trust * math.log(a / b) + (1 - trust) * GUESS_INSIDE, 0.0), MOST)
        self.of[WORD] = max(self.of.get(WORD, GUESS[WORD]), 0.1)  # a word speaks for content

    @staticmethod
    def guess(kind: str) -> float:
        return GUESS.get(kind, GUESS_BLOCK_TEXT if kind[4:].lstrip("/") in _TEXT_TAGS else GUESS_TAG)

    def __call__(self, kind: str) -> float:
        return self.of[kind] if kind in self.of else self.guess(kind)


def region(scores: list[float]) -> tuple[int, int]:
    """The stretch [start, end) with the largest sum, the first of several, by one scan; (0, 0) if no sum is above 0."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, found = total, (start, k + 1)
    return found


def extract(page: str | None, weights: Weights) -> str:
    """The page's main text: its blocks joined by line ends; empty if there is none."""
    line = tokens(page or "")
    scores = []
    for kind, text, inside in line:
        n = 0 if kind == TAG else len(text.split()) if kind in (WORD, LINK) else 1
        scores.append(n * (weights(kind) + (weights.inside if inside else 0.0)))
    start, end = region(scores)

    def breaks(kind: str) -> bool:
        return kind.startswith(TAG) and kind[4:].lstrip("/") in BLOCKS

    if end:  # whole blocks
        while start and not breaks(line[start][0]) and not breaks(line[start - 1][0]):
            start -= 1
        while end < len(line) and not breaks(line[end][0]):
            end += 1
    blocks, now = [], []
    for kind, text, _ in line[start:end]:
        if breaks(kind):
            blocks.append("".join(now))
            now = []
        elif kind != BOX:
            now.append(text)
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def main_text(pages: DataFrame, weights: Weights, id_column: str = "page_id") -> DataFrame:
    """(id, url, text) of each page. Null and empty html give an empty text; a null url stays null. Repeated rows give
    repeated results, an empty table an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            text = [extract(page, weights) for page in column(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["id", "url", "text"])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(F.col(id_column).alias("id"), "url", "html").mapInArrow(run, f"id {kind}, url string, text string")
