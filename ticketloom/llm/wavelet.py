"""Wavelet matrix of a token sequence in one compressed file: access, rank, select, counting and occurrences.

Plane k holds one bit of every token, the highest bit first. Below each plane the tokens whose bit is 0 come before those whose
bit is 1, in their former order. A position is therefore followed from plane to plane by counting bits (rank) and led back by
finding the k-th bit (select). Planes are cut into blocks of `BLOCK` bits, each compressed on its own; the directory holds the
number of ones before each block, so that one lookup reads one block a plane.

    MAGIC | tokens, bits, blocks a plane, length of the document part (uint64 each) | zeros of each plane | ones before each
    block (blocks + 1 a plane) | place of each block (bits x blocks + 1) | documents (Arrow stream: id, length) | blocks

All numbers are little-endian. A block as long as its bits need is stored as it is.
"""

from __future__ import annotations

import io
import struct
from collections import OrderedDict
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard

MAGIC = b"WAVELET1"
BLOCK = 1 << 15
_HEAD = struct.Struct("<8sQQQQ")
_HELD = 256  # blocks that a reader keeps


def build(tokens: np.ndarray, docs: pa.RecordBatch) -> bytes:
    """The file of a sequence (whole numbers from 0 to 2**32 - 1) and its documents (columns id, length, in order)."""
    tokens = np.asarray(tokens)
    bits = max(1, int(tokens.max(initial=0)).bit_length())
    blocks = -(-len(tokens) // BLOCK)
    zeros, ones, places, parts = [], [], [0], []
    pack = zstandard.ZstdCompressor(level=1).compress
    for k in range(bits - 1, -1, -1):
        one = (tokens >> tokens.dtype.type(k) & tokens.dtype.type(1)).astype(bool)
        zeros.append(len(one) - int(np.count_nonzero(one)))
        before = 0
        for at in range(0, len(one), BLOCK):
            raw = np.packbits(one[at : at + BLOCK], bitorder="little").tobytes()
            small = pack(raw)
            parts.append(small if len(small) < len(raw) else raw)
            places.append(places[-1] + len(parts[-1]))
            ones.append(before)
            before += int(np.count_nonzero(one[at : at + BLOCK]))
        ones.append(before)
        tokens = np.concatenate([tokens[~one], tokens[one]])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(docs)
    listed = sink.getvalue()
    head = _HEAD.pack(MAGIC, len(tokens), bits, blocks, len(listed))
    return b"".join([head, *(np.array(x, "<u8").tobytes() for x in (zeros, ones, places)), listed, *parts])


class Shard:
    """A file of `build`, read from anything with seek and read; blocks are read when they are needed."""

    def __init__(self, file: BinaryIO):
        self.file = file
        magic, self.size, self.bits, self.blocks, listed = _HEAD.unpack(file.read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError("no wavelet file")
        self.zeros = np.frombuffer(file.read(8 * self.bits), "<u8").astype(np.int64)
        ones = np.frombuffer(file.read(8 * self.bits * (self.blocks + 1)), "<u8").astype(np.int64)
        self.ones = ones.reshape(self.bits, self.blocks + 1)
        self.places = np.frombuffer(file.read(8 * (self.bits * self.blocks + 1)), "<u8").astype(np.int64)
        self.docs = pa.ipc.open_stream(file.read(listed)).read_all()
        self.first = _HEAD.size + 8 * (self.bits * (2 * self.blocks + 2) + 1) + listed
        self.unpack = zstandard.ZstdDecompressor()
        self.held: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    # ---- planes ----

    def _bits(self, raw: bytes, block: int) -> np.ndarray:
        n = min(BLOCK, self.size - block * BLOCK)
        if len(raw) < -(-n // 8):
            raw = self.unpack.decompress(raw, max_output_size=BLOCK // 8)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little")

    def block(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) in self.held:
            self.held.move_to_end((plane, block))
        else:
            at, end = self.places[plane * self.blocks + block : plane * self.blocks + block + 2].tolist()
            self.file.seek(self.first + at)
            self.held[plane, block] = self._bits(self.file.read(end - at), block)
            if len(self.held) > _HELD:
                self.held.popitem(last=False)
        return self.held[plane, block]

    def _plane(self, plane: int) -> np.ndarray:
        """All bits of a plane in one read."""
        places = self.places[plane * self.blocks : (plane + 1) * self.blocks + 1].tolist()
        self.file.seek(self.first + places[0])
        raw = self.file.read(places[-1] - places[0])
        found = [self._bits(raw[a - places[0] : b - places[0]], k) for k, (a, b) in enumerate(zip(places, places[1:]))]
        return np.concatenate(found).astype(bool) if found else np.zeros(0, bool)

    def _rank(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones of the plane before each position (0 to size)."""
        out = self.ones[plane][at // BLOCK].copy()
        inside = at % BLOCK > 0
        for b in np.unique(at[inside] // BLOCK):
            here = inside & (at // BLOCK == b)
            out[here] += np.cumsum(self.block(plane, int(b)), dtype=np.int64)[at[here] % BLOCK - 1]
        return out

    def _select(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) bit of this kind."""
        before = self.ones[plane] if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK, self.size) - self.ones[plane]
        block = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        for b in np.unique(block):
            here = block == b
            out[here] = b * BLOCK + np.flatnonzero(self.block(plane, int(b)) == bit)[k[here] - before[b]]
        return out

    # ---- tokens ----

    def tokens(self) -> np.ndarray:
        """The whole sequence, planes read from the last to the first."""
        found = np.zeros(self.size, np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            one, above = self._plane(plane), np.empty_like(found)
            above[~one] = found[: self.zeros[plane]]
            above[one] = found[self.zeros[plane] :] | np.uint32(1 << (self.bits - 1 - plane))
            found = above
        return found

    def access(self, at: np.ndarray) -> np.ndarray:
        """Tokens at the given positions."""
        at = np.asarray(at, np.int64)
        if len(at) and not 0 <= at.min() <= at.max() < self.size:
            raise IndexError("position outside the shard")
        found = np.zeros(len(at), np.int64)
        for plane in range(self.bits):
            before = self._rank(plane, at)
            one = self._rank(plane, at + 1) > before
            found = found << 1 | one
            at = np.where(one, self.zeros[plane] + before, at - before)
        return found.astype(np.uint32)

    def _follow(self, token: int, at: list[int]) -> np.ndarray:
        places = np.array(at, np.int64)
        for plane in range(self.bits):
            before = self._rank(plane, places)
            places = self.zeros[plane] + before if token >> (self.bits - 1 - plane) & 1 else places - before
        return places

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in positions from `start` up to `end`."""
        if not 0 <= token < 1 << self.bits:
            return 0
        low, high = self._follow(token, [start, self.size if end is None else end])
        return max(0, int(high - low))

    def find(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Positions of a token from `start` up to `end`, in order."""
        if not 0 <= token < 1 << self.bits:
            return np.zeros(0, np.int64)
        low, high = self._follow(token, [start, self.size if end is None else end])
        at = np.arange(low, max(low, high))
        for plane in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - plane) & 1
            at = self._select(plane, one, at - self.zeros[plane] if one else at)
        return at
