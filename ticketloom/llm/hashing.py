"""Hashed character and word n-grams of whole texts, as numpy arrays over a batch of documents."""

from __future__ import annotations

from functools import cache

import numpy as np

BITS = 16
BUCKETS = 1 << BITS
GAP = 3  # zeros between documents, so that no window of up to four characters holds parts of two


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, each text followed by GAP zeros, and the start of each text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + GAP
    codes = np.zeros(int(size.sum()), np.uint32)
    starts = np.cumsum(size) - size
    for text, at in zip(texts, starts.tolist()):
        codes[at : at + len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, starts


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h ^ h >> np.uint32(15)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def char_grams(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For n from 1 to `longest`, the bucket of the n code points that end at each position."""
    h, out = np.zeros(len(codes), np.uint32), []
    for n in range(longest):
        h[n:] += codes[: len(codes) - n] * np.uint32(((2 * n + 1) * 0x85EBCA6B) & 0xFFFFFFFF)
        h += np.uint32(7919)
        out.append(_bucket(h))
    return out


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x5851F42D4C957F2D)
    inverse = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
    return np.cumprod(np.full(size, base)), np.cumprod(np.full(size, inverse))


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word (a run of code points other than zero and white space)."""
    inside = (codes > 32) | ((codes > 0) & (codes < 9)) | ((codes > 13) & (codes < 32))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(1 << max(16, int(len(codes)).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[: len(codes)])])
    h = (total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)
    return start, h ^ (h >> np.uint64(31))


def word_grams(codes: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(position, bucket) of single words and of pairs of neighbours in the same text."""
    at, h = words(codes)
    fold = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    out = [(at, _bucket(fold + np.uint32(1)))]
    if len(at) > 1:
        same = np.diff(np.searchsorted(starts, at, "right")) == 0
        both = fold[:-1] * np.uint32(31) + fold[1:] + np.uint32(2)
        out.append((at[1:][same], _bucket(both[same])))
    return out


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over each text's positions (values has one row for each position)."""
    return np.add.reduceat(values, starts, axis=0) if len(starts) else values[:0]
