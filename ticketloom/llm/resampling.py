"""Importance resampling towards a target collection, by hashed n-gram weights and an exact distributed selection.

Each run of one or two consecutive words falls into one of `BUCKETS` buckets. A bucket's gain compares its share of the target
with its share of the source; a document's weight is the mean gain of its features, looked up in one array per batch. The
weight plus a Gumbel draw of the document's id orders the documents, and the highest `percent` of them are drawn.

The cutoff is found by weighted median-of-medians: each partition gives the median of its remaining keys and their number, the
median of these weighted by the numbers is the pivot, and the keys on its wrong side are discarded: a quarter of what remains
at least, in every round. The driver sees one row for each partition. Only the winners are sorted.

Words are runs of letters and digits after A-Z were lower-cased; every code point from U+0080 on counts as a letter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, written

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: So few remaining keys are ordered in one go.
LAST = 10_000
#: Bytes of UTF-8 that belong to no word become blanks, A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LEAST_ID = -(1 << 63)


def buckets(text: bytes | None) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each feature: the words, then the pairs of neighbours."""
    words = text.translate(_FOLD).split() if text else []
    one = list(map(crc32, words))
    two = map(crc32, map(b" ".__add__, words[1:]), one)  # a pair's sum goes on from its first word's
    return len(words), np.fromiter(chain(one, two), np.int64, max(0, 2 * len(words) - 1)) % BUCKETS


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in pieces(batches):
        yield batch, batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """(bucket, n) of the buckets that occur; nulls and texts without a word add nothing. One row a bucket leaves each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, texts in _texts(batches):
            total += np.bincount(np.concatenate([buckets(t)[1] for t in texts]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select(F.col(text_column).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of each bucket from the two tables of `bucket_counts` (at most `BUCKETS` rows each)."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for into, counts in ((s, source), (t, target)):
        for bucket, n in counts.collect():
            into[bucket] = n
    all_s, all_t = float(s.sum() + BUCKETS), float(t.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row: the floored mean gain, and that plus the row's Gumbel draw.

    A text that is null or has no word has weight 0. The draw depends on the id alone; a null id counts as empty text there.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            words, features, weights = [], [], []
            for n, found in map(buckets, texts):
                words.append(n)
                features.append(len(found))
                weights.append(int(gain[found].sum()) // len(found) if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weights))], ["id", "n_words", "n_features", "weight"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    draw = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return source.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + draw)


# ---- selection ------------------------------------------------------------------------------------------------------------

Key = tuple[int, int]  # (score, id): a higher score is better, then a smaller id


def _better(key: Key) -> Column:
    return (F.col("score") > key[0]) | ((F.col("score") == key[0]) & (F.col("key") < key[1]))


def _worse(key: Key) -> Column:
    return (F.col("score") < key[0]) | ((F.col("score") == key[0]) & (F.col("key") > key[1]))


def middle(score: np.ndarray, key: np.ndarray) -> Key:
    """The lower median of the pairs, best first."""
    at = (len(score) - 1) // 2
    place = len(score) - 1 - at
    s = int(np.partition(score, place)[place])
    ties = key[score == s]
    at -= int((score > s).sum())
    return s, int(np.partition(ties, at)[at])


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = list(batches)
    if n := sum(b.num_rows for b in found):
        score, key = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in found]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*middle(score, key), n)], ["score", "key", "n"])


def weighted_median(rows: list[tuple[int, int, int]]) -> Key:
    """The pair at which half of the numbers in the third column are reached, best pairs first."""
    half, seen = sum(n for *_, n in rows) / 2, 0
    for score, key, n in sorted(rows, key=lambda r: (-r[0], r[1])):
        seen += n
        if seen >= half:
            break
    return score, key


def cutoff(keys: DataFrame, rank: int, last: int = LAST) -> Key:
    """The pair (score, key) that stands at `rank` (from 1) with the best first; `keys` is read once or twice a round, and what
    remains is written anew whenever three quarters are gone, so that all rounds together read a few times the first input.
    """
    here = keys = written(keys.select("score", "key"), "keys")
    there = size = keys.count()
    while size > last:
        pivot = weighted_median([tuple(r) for r in here.mapInArrow(_medians, "score long, key long, n long").collect()])
        better, worse = here.agg(F.count_if(_better(pivot)), F.count_if(_worse(pivot))).first()
        if rank <= better:
            here, size = here.where(_better(pivot)), better
        elif rank > size - worse:
            here, rank, size = here.where(_worse(pivot)), rank - (size - worse), worse
        else:
            return pivot
        if size > last and 4 * size < there:
            here, there = written(here, "keys"), size
    rest = sorted(((r.score, r.key) for r in here.collect()), key=lambda r: (-r[0], r[1]))
    return rest[rank - 1]


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    id_column: str = "doc_id", text_column: str = "text", target_column: str = "text", last: int = LAST,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of `docs`; rank is null for rows that are not drawn.

    Of the rows with at least `least_words` words, floor(percent * their number / 100) are drawn, by score, then smaller id;
    ids are whole numbers, a null id comes first among equals. Null and empty texts have weight 0 and are never drawn, texts
    of any length are read whole, repeated rows are rows like others (of rows equal in score and id, any may be the one left
    out at the cutoff), an empty table gives an empty result, an empty target is a target without features, other columns
    are not read.
    """
    gain = gains(bucket_counts(docs, text_column), bucket_counts(target, target_column))
    scored = written(weigh(docs, gain, id_column, text_column, seed).withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(_LEAST_ID))), "scored")
    fit = F.col("n_words") >= least_words
    number = scored.where(fit).count() * percent // 100
    out = ["id", "n_words", "n_features", "weight", "score"]
    if number == 0:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    key = cutoff(scored.where(fit), number, last)
    drawn = fit & ~_worse(key)
    order = [F.desc("score"), F.asc("key")]
    won = written(
        scored.where(drawn).repartitionByRange(*order).sortWithinPartitions(*order).select(*out, F.monotonically_increasing_id().alias("at")), "winners"
    )
    part = F.shiftright("at", 33)  # the identifier's upper bits are the partition, the others the place in it
    sizes = sorted(won.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    starts = won.sparkSession.createDataFrame([(r["part"], at) for r, at in zip(sizes, before)], "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = won.withColumn("part", part).join(F.broadcast(starts), "part")  # one row a partition
    return ranked.select(*out, F.when(rank <= number, rank).alias("rank")).unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
