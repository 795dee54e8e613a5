"""Help documents: text of files and pages (Arrow batches), blocks and pieces as column expressions, and headings and sections
by Arrow table functions.

A document is one row, so everything below works inside the row: no exchange, no state between documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .text import strip, word_tokens

# Page chrome that is left out, heading depth per tag, tags that end a text block, file types, encodings
CHROME = frozenset({"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg", "template"})
HEADING_DEPTH = {"h1": 1, "h2": 2, "h3": 3, "h4": 3, "h5": 3, "h6": 3}
BLOCK_TAGS = frozenset({"p", "li", "td", "th", "dd", "dt", "blockquote", "pre", "div", "section", "article", "br", "tr"})
SUPPORTED_SUFFIXES = (".md", ".markdown", ".txt", ".html", ".htm", ".pdf")
TEXT_ENCODINGS = ("utf-8-sig", "cp1252")
# A Markdown heading line, and the blank after a sentence
HEADING_LINE = r"(?dU)^(#{1,6})\s+(.+?)\s*#*\s*$"
AFTER_SENTENCE = r"(?U)(?<=[.!?])\s+"


# --- files and pages -----------------------------------------------------------------------


def decode(data: bytes) -> str | None:
    """Text in the first encoding that fits, None when none does."""
    readable = (_try(data, encoding) for encoding in TEXT_ENCODINGS)
    return next((text for text in readable if text is not None), None)


def _try(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


# Each begins at a place and takes all it has read, also where the page ends in it, so no letter is read from two beginnings.
_UNSEEN = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+(?:>|\Z)""")


def page_text(html: str) -> tuple[str | None, str]:
    """(title, text) of a page: blocks separated by blank lines, headings as # lines.

    The page is cut at its tags once. Running values along the cuts say for each stretch of text whether it lies in page
    chrome or the title, how deep its heading is, and to which block it belongs.
    """
    seen = _UNSEEN.sub("", html)
    last = seen.rfind(">") + 1  # what follows holds no tag
    parts = _TAG.split(seen[:last])
    texts = [*parts[:-1:3], parts[-1] + seen[last:]]
    tags = [("", ""), *zip(parts[1::3], map(str.lower, parts[2::3]))]
    opened = [0 if closing else 1 for closing, _ in tags]
    hidden = accumulate(((2 * o - 1) * (name in CHROME) for o, (_, name) in zip(opened, tags)), lambda depth, step: max(depth + step, 0))
    titled = accumulate((o if name == "title" else None for o, (_, name) in zip(opened, tags)), lambda last, now: last if now is None else now)
    depth = accumulate((o * HEADING_DEPTH[name] if name in HEADING_DEPTH else None for o, (_, name) in zip(opened, tags)), lambda last, now: last if now is None else now)
    block = accumulate(name in HEADING_DEPTH or name in BLOCK_TAGS for _, name in tags)
    stretches = [s for s in zip(block, hidden, titled, depth, map(unescape, texts))]
    title = "".join(text for _, _, inside, _, text in stretches if inside).strip()
    shown = [(number, level or 0, text) for number, off, inside, level, text in stretches if not off and not inside]
    blocks = []
    for (_, level), run in groupby(shown, key=lambda s: s[:2]):
        words = "".join(text for _, _, text in run).split()
        if words:
            blocks.append(" ".join(["#" * level, *words] if level else words))
    return title or None, "\n\n".join(blocks)


# --- headings ------------------------------------------------------------------------------


def blocks_of(content: Column) -> Column:
    """The non-empty blocks of a text, which blank lines separate."""
    return F.filter(F.transform(F.split(content, "\n\n"), lambda b: strip(b)), lambda b: b != "")


def headed(blocks: Column) -> Column:
    """Each block with the depth and text of the heading on its first line; depth 0 for a block without one."""

    def row(block: Column) -> Column:
        line = F.substring_index(block, "\n", 1)
        marked = F.startswith(block, F.lit("#"))  # most blocks are no headings: the pattern is not tried on them
        depth = F.when(marked, F.length(F.regexp_extract(line, HEADING_LINE, 1))).otherwise(0)
        heading = F.when(marked, F.regexp_extract(line, HEADING_LINE, 2)).otherwise("")
        return F.struct(depth.cast("int").alias("depth"), heading.alias("heading"), block.alias("block"))

    return F.transform(blocks, row)


class Path:
    """The headings in force: one of some depth stays until one of the same or a smaller depth follows.

    At most one heading of each depth is held, so a step costs the same however many headings came before. The document's own
    title is left out of the path.
    """

    def __init__(self, title: str | None):
        self.title, self.held = title, []

    def step(self, depth: int, heading: str) -> str:
        self.held = [*(h for h in self.held if h[0] < depth), (depth, heading)]
        return " / ".join(h for _, h in self.held if h != self.title)


# --- pieces and sections -------------------------------------------------------------------

Count = Callable[[Column], Column]


def _piece(text: Column, size: Column) -> Column:
    return F.struct(text.alias("text"), size.cast("int").alias("size"))


def _packed(units: Column, limit: int, glue: str) -> Column:
    """Neighbouring pieces (text, size) joined by `glue` while their sizes sum to at most `limit`: the texts."""
    start = F.struct(F.array().cast("array<string>").alias("full"), F.lit("").alias("held"), F.lit(0).alias("used"))

    def step(so_far: Column, unit: Column) -> Column:
        fits = (so_far["used"] > 0) & (so_far["used"] + unit["size"] <= limit)
        closed = F.when(~fits & (so_far["used"] > 0), F.concat(so_far["full"], F.array(so_far["held"]))).otherwise(so_far["full"])
        held = F.when(fits, F.concat(so_far["held"], F.lit(glue), unit["text"])).otherwise(unit["text"])
        return F.struct(closed.alias("full"), held.alias("held"), (F.when(fits, so_far["used"]).otherwise(0) + unit["size"]).alias("used"))

    return F.aggregate(units, start, step, lambda end: F.when(end["used"] > 0, F.concat(end["full"], F.array(end["held"]))).otherwise(end["full"]))


def pieces_of(paragraph: Column, limit: int, size: Count = word_tokens) -> Column:
    """A paragraph above `limit` in pieces (text, size) of at most `limit`: by sentences, and a longer sentence by words.

    With a size other than words, a stretch of `limit` words that is still too large is cut into stretches of characters.
    """

    def by_words(sentence: Column) -> Column:
        words = F.filter(F.split(sentence, r"(?U)\s+"), lambda w: w != "")
        last = F.greatest(F.floor((F.size(words) - 1) / limit), F.lit(0)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(words, k * limit + 1, limit), " "))
        return sized(runs if size is word_tokens else F.flatten(F.transform(runs, by_letters)))

    def by_letters(run: Column) -> Column:
        wide = F.greatest(F.floor(F.length(run) * limit / F.greatest(size(run), F.lit(1))), F.lit(1)).cast("int")
        last = F.floor((F.length(run) - 1) / wide).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.substr(run, k * wide + 1, wide))
        return F.when(size(run) <= limit, F.array(run)).otherwise(cut)

    def sized(texts: Column) -> Column:
        return F.transform(texts, lambda s: _piece(s, size(s)))

    units = F.flatten(F.transform(sized(F.split(paragraph, AFTER_SENTENCE)), lambda s: F.when(s["size"] <= limit, F.array(s)).otherwise(by_words(s["text"]))))
    return sized(_packed(units, limit, " "))


def measured_blocks(content: Column, limit: int, size: Count = word_tokens) -> Column:
    """The blocks of a text as (depth, heading, pieces): the text under the heading line in pieces (text, size) of at most `limit`."""
    none = F.array().cast("array<struct<text: string, size: int>>")

    def body(b: Column) -> Column:
        under = strip(F.regexp_replace(b["block"], r"(?d)^[^\n]*\n?", ""))  # a heading's own block, which is stripped already
        return F.struct(b["depth"].alias("depth"), b["heading"].alias("heading"), F.when(b["depth"] > 0, under).otherwise(b["block"]).alias("body"))

    def counted(b: Column) -> Column:
        return F.struct(b["depth"].alias("depth"), b["heading"].alias("heading"), _piece(b["body"], size(b["body"])).alias("whole"))

    def row(b: Column) -> Column:
        whole = b["whole"]
        cut = F.when(whole["size"] > limit, pieces_of(whole["text"], limit, size)).when(whole["text"] == "", none).otherwise(F.array(whole))
        return F.struct(b["depth"].alias("depth"), b["heading"].alias("heading"), cut.alias("pieces"))

    # one step after the other: each value is computed once for a block
    return F.transform(F.transform(F.transform(headed(blocks_of(content)), body), counted), row)


# --- table functions -----------------------------------------------------------------------


def _fields(column: pa.Array) -> tuple[list[int], dict[str, pa.Array]]:
    """The ends of a list column's rows, and the fields of all its structs in order."""
    flat = column.flatten()
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0))).tolist()
    return ends, {name: flat.field(k) for k, name in enumerate(flat.type.names)}


def block_table(key: str):
    """Table function over (document_id, title, blocks as `headed` gives them): each block with its position and path."""

    @F.arrow_udtf(returnType=f"document_id {key}, position int, is_heading boolean, path string, block string")
    class Blocks:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            ends, found = _fields(batch.column(2))
            depth, heading = found["depth"].to_pylist(), found["heading"]
            size, paths = np.diff([0, *ends]), []
            for title, start, end in zip(batch.column(1).to_pylist(), [0, *ends], ends):
                own, path = Path(title), ""
                for k in range(start, end):
                    if depth[k]:
                        path = own.step(depth[k], heading[k].as_py())
                    paths.append(path)
            at = pa.array(np.repeat(np.arange(batch.num_rows), size))
            position = np.arange(len(depth)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.table([batch.column(0).take(at), pa.array(position.astype(np.int32)), pc.greater(found["depth"], 0), pa.array(paths, pa.string()), found["block"]],
                           ["document_id", "position", "is_heading", "path", "block"])

    return Blocks


def section_table(key: str, tenant: str, limit: int):
    """Table function over (document_id, tenant_id, title, blocks as `measured_blocks` gives them): the sections in order.

    One pass over the pieces of a document: those under one heading go together while their sizes sum to at most `limit`, and a
    section's title carries the path of headings.
    """

    @F.arrow_udtf(returnType=f"document_id {key}, tenant_id {tenant}, position int, title string, content string")
    class Sections:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            ends, found = _fields(batch.column(3))
            depth, heading = found["depth"].to_pylist(), found["heading"]
            piece_ends, pieces = _fields(found["pieces"])
            sizes, texts = pieces["size"].to_pylist(), pieces["text"].to_pylist()
            of, positions, titles, contents = [], [], [], []
            piece = 0
            for row, (title, start, end) in enumerate(zip(batch.column(2).to_pylist(), [0, *ends], ends)):
                own, name, first = Path(title), title, len(of)
                held, used = [], 0

                def close() -> None:
                    if held:
                        of.append(row)
                        positions.append(len(of) - 1 - first)
                        titles.append(name)
                        contents.append("\n\n".join(held))

                for k in range(start, end):
                    if depth[k]:
                        close()
                        held, used = [], 0
                        path = own.step(depth[k], heading[k].as_py())
                        name = f"{title}: {path}" if path else title
                    while piece < piece_ends[k]:
                        if used and used + sizes[piece] > limit:
                            close()
                            held, used = [], 0
                        held.append(texts[piece])
                        used += sizes[piece]
                        piece += 1
                close()
            at = pa.array(of, pa.int64())
            yield pa.table([batch.column(0).take(at), batch.column(1).take(at), pa.array(positions, pa.int32()), pa.array(titles, pa.string()), pa.array(contents, pa.string())],
                           ["document_id", "tenant_id", "position", "title", "content"])

    return Sections
