"""A single search for the literals without which none of many patterns can match.

From each pattern a set of literals is derived of which every match contains at least one. All sets together become one
expression that reads a text once and gives the literals found; a pattern is then tried only where one of its own was.
"""

from __future__ import annotations

import re
from re import _constants as op, _parser as parser

from pyspark.sql import Column, functions as F

MOST_EXACT, MOST_LITERALS = 64, 200
LEAST = 3  # letters of a literal; shorter ones are everywhere


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest literal is longer, then the smaller set; None stands for no set."""
    usable = [s for s in (a, b) if s and min(map(len, s)) >= LEAST and len(s) <= MOST_LITERALS]
    return max(usable, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _exact(code, arg) -> set[str] | None:
    """All texts that an element matches, if they are few."""
    if code is op.LITERAL:
        return {chr(arg)}
    if code in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {""}  # takes no letter
    if code is op.IN and len(arg) <= 4 and all(c is op.LITERAL for c, _ in arg):
        return {chr(v) for _, v in arg}
    if code is op.SUBPATTERN:
        return _exact_all(arg[-1])
    if code is op.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] == 1:
        inner = _exact_all(arg[2])
        return inner if inner is None or arg[0] else inner | {""}
    return None


def _exact_all(sequence) -> set[str] | None:
    found = {""}
    for code, arg in sequence:
        part = _exact(code, arg)
        if part is None or len(found) * len(part) > MOST_EXACT:
            return None
        found = {a + b for a in found for b in part}
    return found


def _needed(sequence) -> set[str] | None:
    best, run = None, {""}
    for code, arg in sequence:
        part = _exact(code, arg)
        if part is not None and len(run) * len(part) <= MOST_EXACT:
            run = {a + b for a in run for b in part}
            continue
        best, run = _better(best, run), part or {""}
        if part is None:
            inner = None
            if code is op.SUBPATTERN:
                inner = _needed(arg[-1])
            elif code is op.BRANCH:
                parts = [_needed(p) for p in arg[1]]
                inner = set().union(*parts) if all(parts) else None
            elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
                inner = _needed(arg[2])
            best = _better(best, inner)
    return _better(best, run)


def literals(pattern: str) -> set[str] | None:
    """Literals of which each match of the pattern contains one; None if there is no such set worth a search."""
    return _needed(parser.parse(pattern))


def prefix_free(sets: dict[str, set[str]]) -> dict[str, set[str]]:
    """The sets with each literal cut to the shortest literal of all sets that begins it, so that one place has one at most."""
    every = set().union(*sets.values()) if sets else set()
    shortest = {w: next(w[:n] for n in range(1, len(w) + 1) if w[:n] in every) for w in every}
    return {name: {shortest[w] for w in words} for name, words in sets.items()}


def _tree(words: set[str]) -> str:
    """A pattern for one of these words (none the beginning of another) that tests each letter once."""
    heads: dict[str, set[str]] = {}
    for word in words:
        heads.setdefault(word[0], set()).add(word[1:])
    parts = [re.escape(head) + ("" if rest == {""} else _tree(rest)) for head, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


class Prefilter:
    """One search for the literals of several named patterns."""

    def __init__(self, patterns: dict[str, str]):
        self.sets = prefix_free({name: found for name, p in patterns.items() if (found := literals(p))})

    def found(self, text: Column) -> Column:
        """The different literals in the text, as the patterns see it."""
        words = set().union(*self.sets.values()) if self.sets else {"\0"}
        heads = "".join(sorted({re.escape(w[0]) for w in words}))
        return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=[{heads}])(?=({_tree(words)}))"), F.lit(1)))

    def possible(self, name: str, found: Column) -> Column:
        """Whether the pattern can match a text in which these literals were found."""
        if name not in self.sets:
            return F.lit(True)
        return F.arrays_overlap(found, F.array(*map(F.lit, sorted(self.sets[name]))))
