"""Packing documents into token sequences along a space-filling curve.

Each text is tokenised once; a hashed vector of its tokens is projected to `AXES` dimensions, scaled by the mean and deviation
over all documents, and turned into a Hilbert key. Spark sorts the documents by range of (key, id), so neighbours in a
partition are alike, and every partition packs its documents in that order, one after another, cutting where a sequence is
full. What is left at a partition's end is cut into sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pieces, written

LENGTH = 2048
END = 1  # the id after each document
AXES = 3
KEY_BITS = 10  # of each axis
HASHES = 4096


#: Runs of white space that are cut without the library; shorter ones are no trouble to it.
_LONG_RUN = regex.compile(r"\s{10000,}+")


# ---- tokens -------------------------------------------------------------------------------------------------------------


class Ids:
    """Ids of whole texts, as the vocabulary file (JSON, byte-level BPE) gives them without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # the file writes bytes that are no visible character as code points from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): k for token, k in vocabulary.items() if all(c in byte for c in token)}
        special = max(vocabulary.values())
        ranks = {t: k for t, k in ranks.items() if not (k == special and t.startswith(b"<|"))}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.small = special < 1 << 16  # then two bytes hold an id between the steps
        hashed = (np.arange(special + 1, dtype=np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(HASHES)
        marks = np.random.default_rng(20).normal(size=(AXES, HASHES)).astype(np.float32)
        self.axes = [np.ascontiguousarray(row[hashed]) for row in marks]  # projection of hashed tokens

    def _plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the text and the end id. A long run of white space is cut as the pattern cuts it, without the library's
        search, which goes back over such a run: all of it but its last character is a piece, or all of it at the end."""
        text = text or ""
        parts, at = [], 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts += [self._plain(text[at : run.start()]), np.array(self.encoding._encode_single_piece(text[run.start() : end]), np.uint32)]
            at = end
        return np.concatenate([*parts, self._plain(text[at:]), np.array([END], np.uint32)])

    def vector(self, ids: np.ndarray) -> list[float]:
        return [float(axis[ids].mean()) for axis in self.axes]


@cache
def tokenizer(path: str, pattern: str) -> Ids:
    return Ids(path, pattern)


# ---- curve --------------------------------------------------------------------------------------------------------------


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below 2**bits (one row each)."""
    x = axes.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations from the largest cube inwards
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


# ---- packing ------------------------------------------------------------------------------------------------------------

_PIECE = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Cuts a stream of documents into sequences; `first` is the first sequence's number."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.filled = length, first, 0
        self.open: list[tuple] = []  # pieces of the sequence that is not full

    def add(self, doc, ids: np.ndarray) -> list[tuple]:
        """The pieces of all sequences that this document fills."""
        done, at = [], 0
        while at < len(ids):
            take = min(self.length - self.filled, len(ids) - at)
            self.open.append((doc, at, ids[at : at + take], len(ids)))
            self.filled, at = self.filled + take, at + take
            if self.filled == self.length:
                done += self._close(self.open)
                self.open, self.filled = [], 0
        return done

    def _close(self, parts: list[tuple]) -> list[tuple]:
        offset, rows = 0, []
        for doc, start, ids, total in parts:
            rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        return rows

    def end(self) -> list[tuple]:
        """The rest, in sequences of a power of two each, the longest first."""
        rows, left, parts = [], self.filled, self.open
        while left:
            size, taken, rest = 1 << (left.bit_length() - 1), [], []
            room = size
            for doc, start, ids, total in parts:
                n = min(room, len(ids))
                if n:
                    taken.append((doc, start, ids[:n], total))
                if n < len(ids):
                    rest.append((doc, start + n, ids[n:], total))
                room -= n
            rows += self._close(taken)
            parts, left = rest, left - size
        self.open, self.filled = [], 0
        return rows


def pack(
    docs: DataFrame, path: str, pattern: str, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) of each piece of a document.

    ids are little-endian unsigned 32-bit integers. A null or empty text has the end id alone. Repeated rows are packed like
    others; an empty table gives an empty result; other columns are not read. `length` must be a power of two.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in pieces(batches):
            ids = list(map(own.encode, column(batch, "text")))
            where = np.array([own.vector(x) for x in ids]).reshape(-1, AXES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.astype("<u2" if own.small else "<u4").tobytes() for x in ids], pa.binary()), *(pa.array(where[:, k]) for k in range(AXES))],
                ["id", "ids", *(f"x{k}" for k in range(AXES))],
            )

    axes = [f"x{k}" for k in range(AXES)]
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    tokens = written(source.mapInArrow(tokenise, f"id {kind}, ids binary, " + ", ".join(f"{a} double" for a in axes)), "tokens")
    row = tokens.agg(*(F.avg(a).alias(f"m{a}") for a in axes), *(F.stddev_pop(a).alias(f"s{a}") for a in axes)).first()
    mean = [row[f"m{a}"] or 0.0 for a in axes]
    deviation = [row[f"s{a}"] or 1.0 for a in axes]

    @F.pandas_udf("long")
    def key(x0: pd.Series, x1: pd.Series, x2: pd.Series) -> pd.Series:
        z = (np.column_stack([x0, x1, x2]) - mean) / deviation
        return pd.Series(hilbert(np.clip((z + 4) / 8 * (1 << KEY_BITS), 0, (1 << KEY_BITS) - 1), KEY_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        small = tokenizer(path, pattern).small

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], _PIECE)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            found = []
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                found += packer.add(doc, np.frombuffer(ids.as_buffer(), "<u2" if small else "<u4"))
                if len(found) > 4096:
                    yield rows(found)
                    found = []
            if found:
                yield rows(found)
        if rest := packer.end():
            yield rows(rest)

    curve = tokens.select("id", "ids", key(*axes).alias("key")).repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return curve.select("id", "ids").mapInArrow(run, schema)
