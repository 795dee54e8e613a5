"""Evaluation passages inside longer training texts.

Texts are compared by their normalised words. A window is a run of `least` words; a text leaks an item when one of the item's
windows occurs in it. Looking for all windows everywhere would pair each common phrase with each item that has it, so three
steps lead to the few pairs that are compared word by word:

1. One pass over the texts keeps the stretches of at least `least` words whose every run of `shingle` words occurs in some
   item, judged by a bit map of fixed size that misses none. This is all of a corpus that is ever shuffled.
2. Of each window of an item, only its rarest run of words (by its number in those stretches) is an anchor. Whoever has the
   window has its anchor, and runs that stand in a rarer one's window take no part in the join.
3. The pairs that share an anchor are read word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window as W

from ..functions.batches import WordRuns, slices
from ..functions.text import leak_key
from ..session import checkpointed

LEAST = 8  # words of a passage
SHINGLE = 5
SHARE = 0.8  # of an item's windows
#: The bit map has 2 ** MAP_BITS bits (2 MB), whatever the number of items.
MAP_BITS = 24


def _normalised(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name), leak_key(text).alias("text"))


def _item_runs(items: DataFrame, shingle: int) -> DataFrame:
    """(item, position, hash) of each run of `shingle` words of the items."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            own = WordRuns(batch.column(1), shingle)
            at = np.flatnonzero(own.whole)
            of = np.searchsorted(own.starts, at, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(at - own.starts[of]), pa.array(own.hashes[at])], ["item", "position", "hash"])

    return items.select("item", "text").mapInArrow(runs, "item long, position long, hash long")


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """One bit for each slot that a hash falls into; the driver sees at most 2 ** (MAP_BITS - 6) words."""
    slot = F.col("hash").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = hashes.select(F.shiftright(slot, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _stretches(texts: DataFrame, bits: np.ndarray, kind: str, least: int, shingle: int) -> DataFrame:
    """(row, row_id, start, words, hashes): the stretches of each text whose every run may occur in an item."""
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33  # of the row: ids may repeat
        for batch in slices(batches, 1):
            own = WordRuns(batch.column(1), shingle)
            slot = own.hashes.view(np.uint64) & np.uint64((1 << MAP_BITS) - 1)
            hit = own.whole & (held.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = last - first + shingle - 1 >= least
            first, last = first[long], last[long]
            of = np.searchsorted(own.starts, first, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(number + of), batch.column(0).take(pa.array(of)), pa.array(first - own.starts[of]),
                    pa.array([own.text_of(a, b + shingle - 1) for a, b in zip(first.tolist(), last.tolist())], pa.string()),
                    pa.array([own.hashes[a:b] for a, b in zip(first, last)], pa.list_(pa.int64())),
                ],
                ["row", "row_id", "start", "words", "hashes"],
            )
            number += batch.num_rows

    return texts.mapInArrow(find, f"row long, row_id {kind}, start long, words string, hashes array<long>")


def _common(words: list[str], windows: dict[tuple, int], least: int) -> list[tuple[int, int, list[int]]]:
    """(start, words, windows of the item met) of each maximal run of positions at which a window of the item starts."""
    out: list[tuple[int, int, list[int]]] = []
    held: list[int] = []
    for at in range(len(words) - least + 2):
        place = windows.get(tuple(words[at : at + least]))
        if place is not None:
            held.append(place)
        elif held:
            out.append((at - len(held), len(held) + least - 1, sorted(set(held))))
            held = []
    return out


def passages(
    texts: DataFrame, items: DataFrame, least: int = LEAST, shingle: int = SHINGLE,
    row_id: str = "row_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(row_id, item_id, spans, shared, windows, share) for each text and item that have a window of `least` words in common.

    spans: the stretches of the text that consist of the item's windows, as "start:words" in order, start counting words from 0;
    shared: different windows of the item that occur in the text; windows: different windows of the item; share: their ratio.
    Words are those of the normalised text. An item of fewer than `least` words has no window and is found by equality alone
    (`feedback.leak_rows`); null and empty texts have none either. Repeated rows each get their own result; other columns are
    not read. Every pair is reported, however common the passage.
    """
    if not 2 <= shingle <= least:
        raise ValueError("a shingle has at least two words and no more than a passage")
    name = dict(items.dtypes)[item_id]
    numbered = _normalised(items, item_id, item_text, "item_id").withColumn("item", F.monotonically_increasing_id())
    numbered = checkpointed(numbered, "leak-items")  # numbers stay as they are
    runs = checkpointed(_item_runs(numbered, shingle), "leak-runs")
    plain = _normalised(texts, row_id, text, "row_id")
    found = checkpointed(_stretches(plain, _bit_map(runs), dict(texts.dtypes)[row_id], least, shingle), "leak-stretches")

    seen = found.select("row", F.explode(F.array_distinct("hashes")).alias("hash"))
    number = runs.join(seen.groupBy("hash").agg(F.count("*").alias("n")), "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    window = W.partitionBy("item").orderBy("position").rowsBetween(0, least - shingle)  # one item's words: a stored row
    rarest = F.min(F.struct("n", "hash")).over(window)
    in_window = F.count("*").over(window) == least - shingle + 1
    anchors = number.select("item", rarest.alias("rarest"), in_window.alias("whole")).where("whole AND rarest.n > 0").select("item", F.col("rarest.hash").alias("hash")).distinct()

    pairs = found.select("row", "start", F.explode(F.array_distinct("hashes")).alias("hash")).join(anchors, "hash").select("row", "start", "item").distinct()
    both = pairs.join(found.select("row", "row_id", "start", "words"), ["row", "start"]).join(numbered.select("item", "item_id", F.col("text").alias("item_words")), "item")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            columns: list[list] = [[] for _ in range(7)]
            known: dict[int, dict] = {}
            for row, key, start, words, item, item_key, item_words in zip(*(c.to_pylist() for c in batch.columns)):
                if item not in known:
                    split = item_words.split(" ")
                    grams = [tuple(split[k : k + least]) for k in range(len(split) - least + 1)]
                    known[item] = {g: k for k, g in reversed(list(enumerate(grams)))}
                for at, size, met in _common(words.split(" "), known[item], least):
                    for column, value in zip(columns, (row, key, item, item_key, {"start": start + at, "words": size}, met, len(known[item]))):
                        column.append(value)
            span = pa.struct([("start", pa.int64()), ("words", pa.int64())])
            kinds = (pa.int64(), batch.column(1).type, pa.int64(), batch.column(5).type, span, pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["row", "row_id", "item", "item_id", "span", "met", "windows"])

    schema = f"row long, row_id {dict(texts.dtypes)[row_id]}, item long, item_id {name}, span struct<start: long, words: long>, met array<long>, windows long"
    read_pairs = both.select("row", "row_id", "start", "words", "item", "item_id", "item_words").mapInArrow(read, schema)
    spans = F.transform(F.array_sort(F.collect_list("span")), lambda s: F.concat_ws(":", s["start"], s["words"]))
    shared = F.size(F.array_distinct(F.flatten(F.collect_list("met")))).cast("long")
    grouped = read_pairs.groupBy("row", "item").agg(
        F.first("row_id").alias("row_id"), F.first("item_id").alias("item_id"), F.array_join(spans, ",").alias("spans"), shared.alias("shared"), F.first("windows").alias("windows")
    )
    return grouped.select("row_id", "item_id", "spans", "shared", "windows", (F.col("shared") / F.col("windows")).alias("share"))


def without_passages(texts: DataFrame, items: DataFrame, share: float = SHARE, row_id: str = "row_id", **more) -> DataFrame:
    """The rows of `texts` that contain no item to at least `share` of its windows; rows with a null id stay."""
    leaked = passages(texts, items, row_id=row_id, **more).where(F.col("share") >= share).select(F.col("row_id").alias(row_id)).distinct()
    return texts.join(leaked, row_id, "left_anti")
