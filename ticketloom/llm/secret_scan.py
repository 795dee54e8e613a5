"""Secret scans over a trigram inverted index.

From each rule's pattern a Boolean query of trigrams is derived that every text with a match must satisfy. The texts of an
Arrow batch form an index segment: postings of the trigrams that occur in any query. Each query is answered by intersecting and
uniting postings, and the pattern is run over its candidates only; a rule without mandatory trigrams scans every text.
The segment lies beside its texts, so neither texts nor postings are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pieces

#: Alternatives and letters of a literal that the derivation keeps apart.
MOST_STRINGS, MOST_CLASS = 64, 8


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; those whose `group` is shorter than `least` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules.
BASE = (
    Rule(
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Published key formats that the base rules do not name.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$*+=-]+@[A-Za-z0-9-]"),
)
RULES = BASE + MORE


# ---- queries ------------------------------------------------------------------------------------------------------------
# A query is True (no condition), a trigram (three lower-case bytes), or ("and" | "or", set of queries).


def _join(kind: str, parts: list) -> object:
    parts = [p for p in parts if p is not True] if kind == "and" else parts
    if kind == "or" and any(p is True for p in parts):
        return True
    unique = frozenset(parts)
    if not unique:
        return True
    return next(iter(unique)) if len(unique) == 1 else (kind, unique)


def _of_strings(strings: set[bytes]) -> object:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _letters(items: list) -> set[bytes] | None:
    """The lower-case letters of a class, if they are few."""
    found: set[bytes] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes = [value]
        elif kind is op.RANGE and value[1] - value[0] < 4 * MOST_CLASS:
            codes = range(value[0], value[1] + 1)
        else:
            return None
        found |= {chr(c).encode().lower() for c in codes}
    return found if len(found) <= MOST_CLASS else None


def _walk(node) -> tuple[set[bytes] | None, object]:
    """(all strings that the node matches, if they are few; the query of its matches)."""
    strings: set[bytes] | None = {b""}
    exact, conditions = True, []

    def flush() -> None:
        nonlocal strings
        conditions.append(_of_strings(strings))
        strings = {b""}

    for kind, value in node:
        query: object = True
        if kind is op.LITERAL:
            part = {chr(value).encode().lower()}
        elif kind is op.IN:
            part = _letters(value)
        elif kind is op.SUBPATTERN:
            part, query = _walk(value[-1])
        elif kind is op.BRANCH:
            found = [_walk(branch) for branch in value[1]]
            part = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
            query = _join("or", [q for _, q in found])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = value
            part, query = _walk(inner)
            if least == most == 1:
                pass
            elif (least, most) == (0, 1) and part is not None:
                part, query = part | {b""}, True
            else:
                part, query = None, query if least else True
        elif kind is op.AT:
            continue
        else:
            part = None
        if part is not None and len(strings) * len(part) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in part}
        else:
            flush()
            exact = False
            conditions.append(query)
            if part is not None:
                strings = part
    whole = strings if exact else None
    flush()
    return whole, _join("and", conditions)


@cache
def trigram_query(pattern: str) -> object:
    """A condition on the trigrams of a text, in lower-case bytes, that holds for every text with a match."""
    return _walk(parser.parse(pattern))[1]


def trigrams(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


# ---- index --------------------------------------------------------------------------------------------------------------


class Segment:
    """Postings of the wanted trigrams over some texts; positions in the list are the documents."""

    def __init__(self, texts: list[str], wanted: Wanted):
        data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        size = np.fromiter(map(len, data), np.int64, len(data)) + 3
        letters = np.frombuffer(b"\0\0\0".join([*data, b""]), np.uint8).astype(np.uint32)
        code = letters[:-2] << 16 | letters[1:-1] << 8 | letters[2:] if len(letters) > 2 else letters[:0]
        number = wanted.number[code]
        at = np.flatnonzero(number)
        doc = np.searchsorted(np.cumsum(size), at, "right")
        pairs = np.unique(number[at].astype(np.int64) << 40 | doc)
        self.all = np.arange(len(texts))
        cuts = np.searchsorted(pairs >> 40, np.arange(1, len(wanted.names) + 2))
        self.postings = {name: pairs[a:b] & ((1 << 40) - 1) for name, a, b in zip(wanted.names, cuts, cuts[1:])}

    def answer(self, query: object) -> np.ndarray:
        if query is True:
            return self.all
        if isinstance(query, bytes):
            return self.postings[query]
        kind, parts = query
        found = sorted((self.answer(p) for p in parts), key=len)
        result = found[0]
        for more in found[1:]:
            result = np.intersect1d(result, more, assume_unique=True) if kind == "and" else np.union1d(result, more)
        return result


class Wanted:
    """The trigrams of some rules' queries, and a number (from 1) for each."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.names = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
        self.number = np.zeros(1 << 24, np.uint16)
        for k, name in enumerate(self.names):
            self.number[int.from_bytes(name, "big")] = k + 1


@cache
def _prepared(rules: tuple[Rule, ...]) -> tuple[Wanted, list[re.Pattern]]:
    return Wanted(rules), [re.compile(r.pattern, re.ASCII) for r in rules]


def find(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of each text's matches in code points, in this order."""
    texts = [t or "" for t in texts]
    wanted, patterns = _prepared(rules)
    segment = Segment(texts, wanted)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, pattern) in enumerate(zip(rules, patterns)):
        for i in segment.answer(trigram_query(rule.pattern)).tolist():
            for m in pattern.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    for spans in found:
        spans.sort()
    return found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans) of each row: spans is an array of (start, kind, end), by start, then by the order of the rules.

    Null and empty texts have no spans. Repeated rows give repeated results, an empty table an empty result; other columns
    are not read.
    """
    kinds = [r.kind for r in rules]
    struct = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            spans = [[{"start": a, "kind": kinds[k], "end": b} for a, k, b in s] for s in find(column(batch, "text"), rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, struct)], ["id", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"id {kind}, spans array<struct<start: long, kind: string, end: long>>")


def mask(text: str | None, spans: list[tuple[int, int, int]], by: str) -> str | None:
    """The text with every stretch that spans cover replaced."""
    if not spans:
        return text
    out, at, until = [], 0, -1
    for start, _, end in spans:
        if start > until:
            if until >= 0:
                at = until
            out += [text[at:start], by]
            until = end
        else:
            until = max(until, end)
    return "".join([*out, text[until:]])


def masked(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES, by: str = "[secret]") -> DataFrame:
    """All rows and columns of `docs`, with secrets in the text replaced; texts without one are untouched, nulls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_column):
            texts = column(batch, text_column)
            clean = [mask(t, s, by) for t, s in zip(texts, find(texts, rules))]
            yield batch.set_column(batch.schema.get_field_index(text_column), text_column, pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)
