"""Long alternations in a form a backtracking regex engine searches quickly.

Java tries every alternative at every position. Grouping the alternatives that start at a word
boundary and looking at the first letter before trying any of them gives the same matches at a
fraction of the work. Letters are expected in lower case, as the texts searched are lowered once.
"""

from __future__ import annotations


def alternatives(pattern: str) -> list[str]:
    """The pattern cut at its outermost bars."""
    parts, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def first_letters(part: str) -> set[str] | None:
    """Characters an alternative can start with, None when that is not plain to see."""
    part = part.removeprefix(r"\b")
    if part.startswith(r"\d"):
        return {"0-9"}
    if part.startswith("("):
        depth = 0
        for end, c in enumerate(part):
            depth += (c == "(") - (c == ")")
            if not depth:
                break
        inner = [first_letters(p) for p in alternatives(part[1:end])]
        optional = part[end + 1 : end + 2] in ("?", "*")
        return None if optional or None in inner else set().union(*inner)
    plain = part[:1].isalnum() and part[1:2] not in ("?", "*")
    return {part[0]} if plain else None


def searchable(pattern: str) -> str:
    """An equivalent of `pattern` for a yes-or-no search in lower-case text."""
    groups: dict[tuple[bool, bool], list[str]] = {}
    for part in alternatives(pattern):
        at_word = part.startswith(r"\b")
        groups.setdefault((at_word, first_letters(part) is None), []).append(part.removeprefix(r"\b"))
    out = []
    for (at_word, unknown), parts in groups.items():
        letters = "" if unknown else "".join(sorted(set().union(*map(first_letters, parts))))
        out.append((r"\b" if at_word else "") + (f"(?=[{letters}])" if letters else "") + f"(?:{'|'.join(parts)})")
    return "|".join(out)
