"""Near duplicates by SimHash fingerprints, searched with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. The binary Golay code of length 23 is perfect: every
23-bit word lies within distance 3 of exactly one codeword. `near(v)`, the codewords to which v and its 23 one-bit changes
decode (one or six of them), therefore shares `nearest(w)` with every w at distance 0 or 1 from v.

Three errors in three segments leave either a segment without error beside one with at most one error, or one error in each
segment. So two fingerprints at distance 3 or less share one of these keys:

* a segment's exact bits with a codeword of another segment (6 ordered pairs), or
* a codeword of each segment, fuzzy in the first for one of the two fingerprints and in the others for the other one.

Fingerprints meet by key in a shuffle, and the members of a key are verified by their true distance. A key gives the edges
of a spanning forest of its members, never all pairs. Keys with more than `KEY_ROWS` members are dealt out again by finer keys
(the fingerprint's 16-bit quarters, one of which has no error).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import column, written
from .components import components

SEED = 42
DISTANCE = 3
WORDS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a key that are verified at once; more are dealt out again by finer keys.
KEY_ROWS = 4096
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code


# ---- fingerprints -------------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash over `words`-word shingles, repeats included, of the text with A-Z in lower case; no word: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split() cuts at the same six characters
    if not tokens:
        return 0
    line = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    count = max(1, len(tokens) - words + 1)
    ends = ends.tolist()[-count:] if len(tokens) >= words else [len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t) for t in column(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], ["id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, fp long")


# ---- Golay code ---------------------------------------------------------------------------------------------------------


def _syndromes(words: np.ndarray) -> np.ndarray:
    left = words.copy()
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


def _corrections() -> np.ndarray:
    """The error pattern of weight 3 or less for each of the 2,048 syndromes."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one).ravel()
    errors = np.unique(np.concatenate([[0], (two[:, None] | one).ravel()]))
    table = np.zeros(2048, np.int64)
    table[_syndromes(errors)] = errors
    return table


_HIGH = _syndromes(np.arange(4096) << 11)
_ERRORS = _corrections()


def nearest(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword within distance 3."""
    return (words ^ _ERRORS[_HIGH[words >> 11] ^ (words & 2047)]) >> 11


def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords that a word or one of its one-bit changes decodes to: (row, index), each once."""
    found = np.sort(nearest(words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])), axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(fresh)[0], found[fresh]


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit key of several numbers; a clash costs a comparison, not a wrong link."""
    key = np.zeros(1, np.uint64)
    for part in parts:
        key = (key ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ (key >> np.uint64(29))
    return key


def keys(marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) arrays of fingerprints (uint64); fingerprints at distance 3 or less share a key."""
    parts = [(marks >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    rows = np.arange(len(marks))
    single = [nearest(p) for p in parts]
    several = [near(p) for p in parts]
    for i in range(3):
        for j in range(3):
            if i != j:
                row, index = several[j]
                yield row, _mixed(3 * i + j + 1, parts[i][row], index)
    row, index = several[0]
    yield row, _mixed(99, index, single[1][row], single[2][row])
    (row_b, in_b), (row_c, in_c) = several[1], several[2]
    first, number = np.searchsorted(row_c, row_b), np.bincount(row_c, minlength=len(rows))[row_b]
    left = np.repeat(np.arange(len(row_b)), number)
    right = np.repeat(first, number) + np.arange(len(left)) - np.repeat(np.cumsum(number) - number, number)
    row = row_b[left]
    yield row, _mixed(99, single[0][row], in_b[left], in_c[right])


# ---- search -------------------------------------------------------------------------------------------------------------


def forest(marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of distinct fingerprints linked at distance 3 or less."""
    left = marks
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            close = np.bitwise_count(left ^ at) <= DISTANCE
            if close.any():
                found, left = left[close], left[~close]
                yield np.full(len(found), at), found
                frontier.extend(found)


def _batch(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    third = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), third], ["a", "b", "key"])


def _links(last: bool):
    """For rows (key, fp) sorted by key: edges (a, b, null), and rows (fp, fp, finer key) of keys with too many members."""

    def settle(marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        marks = np.unique(marks)
        if len(edges := list(forest(marks))):
            yield _batch(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))

    def finer(key: int, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        for q in range(4):
            quarter = marks >> np.uint64(16 * q) & np.uint64(0xFFFF)
            yield _batch(marks, marks, _mixed(q + 200, np.full(len(marks), key, np.uint64), quarter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, crowded = None, [], False
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            fp = batch.column(1).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            inner = slice(1, len(starts) - 1)
            # keys that begin and end inside the batch: most have one member, many two
            size = ends[inner] - starts[inner]
            pair = starts[inner][size == 2]
            close = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= DISTANCE]
            close = close[fp[close] != fp[close + 1]]
            if len(close):
                yield _batch(fp[close], fp[close + 1])
            whole = [(s, e) for s, e in zip(starts[inner][size > 2], ends[inner][size > 2])]
            for s, e in [(0, ends[0]), *whole, *([(starts[-1], len(key))] if len(starts) > 1 else [])]:
                if held != key[s]:
                    if waiting:
                        yield from settle(np.concatenate(waiting))
                    held, waiting, crowded = key[s], [], False
                waiting.append(fp[s:e])
                if not last and (crowded or sum(map(len, waiting)) > KEY_ROWS):
                    crowded = True
                    yield from finer(int(held), np.concatenate(waiting))
                    waiting = []
        if waiting:
            yield from settle(np.concatenate(waiting))

    return run


def links(marks: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) at distance 3 or less, as a forest per key."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                for row, key in keys(fp):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64))], ["key", "fp"])

    rows = marks.select("fp").mapInArrow(expand, "key long, fp long")
    found = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links(False), "a long, b long, key long"), "links")
    again = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp")).repartition("key").sortWithinPartitions("key")
    more = again.mapInArrow(_links(True), "a long, b long, key long")
    return found.where("key IS NULL").select("a", "b").unionByName(more.select("a", "b"))


def groups(marks: DataFrame) -> DataFrame:
    """(fp, component, lead) of each distinct fingerprint among rows (id, fp): the smallest id that it is linked to over any
    number of links (null only if all ids are), and the fingerprint of a row with that id."""
    distinct = marks.groupBy("fp").agg(F.min("id").alias("least"))
    roots = written(components(links(distinct)), "components")
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    joined = joined.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("first")
    named = joined.select("fp", "root").join(joined.groupBy("root").agg(first), "root")
    return named.select("fp", F.col("first.least").alias("component"), F.col("first.fp").alias("lead"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp, component): each row's fingerprint as a signed 64-bit number, and the smallest id that it is linked to
    over any number of links, itself included.

    Null and empty texts and texts without words have fingerprint 0 and are linked like any other. Repeated rows give
    repeated result rows; null ids count for linking, but a component's id is null only if all its ids are. An empty table
    gives an empty result; other columns of `docs` are not read.
    """
    marks = written(fingerprints(docs, id_column, text_column), "fingerprints")
    return marks.join(groups(marks).select("fp", "component"), "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each group of linked rows one, with all its columns: the one with the smallest id; of repeated rows one.

    A null id comes after all others. Rows meet by id and fingerprint, so a large group of copies is not gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t) for t in column(batch, text_column)], np.uint64).view(np.int64)
            yield batch.append_column("__fp", pa.array(marks))

    rows = written(docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__fp", LongType())])), "marked")
    leads = groups(rows.select(F.col(id_column).alias("id"), F.col("__fp").alias("fp"))).where("fp = lead").select("component", "lead")
    kept = rows.join(leads, rows[id_column].eqNullSafe(leads["component"]) & (rows["__fp"] == leads["lead"])).select(rows.columns)
    return kept.dropDuplicates([id_column, "__fp"]).drop("__fp")
