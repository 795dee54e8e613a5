"""Spelling variants: words of a corpus grouped by their most frequent neighbour at edit distance one.

Two words at distance one first differ at some place; before it they share a prefix, after it a suffix. A key (m, lo, hi, prefix,
suffix) gathers the words that can form a pair whose shorter word has m letters and whose first difference lies in [lo, hi):
they share the first lo letters and, from the place hi on, the last m - hi. Every word starts in two halves of [0, m] for m its
own length and for m one less; keys with more than `GROUP` words are halved again until the rest are small. With one place
left, a key has one or two free letters of a fixed alphabet, so its size has a bound that no corpus exceeds. Each pair of
words meets in exactly one key, from each side once.

In a task, whole keys are gathered to blocks of about `BLOCK` words. A block's index has, for each place and letter, one bit for
every word. All words of the block are looked up at once: a step takes the bits of each word's next letter, shifted by one
place to either side for inserted and deleted letters, and updates two kinds of sets, the words equal so far and the words
with one error so far.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, written

LETTERS = 5  # least code points of a word
OCCURRENCES = 3
TIMES = 2  # a form is at least so many times as frequent
MODULUS = 97
GROUP = 2048
BLOCK = 512
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
#: A run after A-Z were lower-cased.
_RUN = re.compile("[a-z\u00C0-\u00FF]+")


# ---- words --------------------------------------------------------------------------------------------------------------


def runs(doc: object, text: bytes, modulus: int) -> Iterator[tuple[str, int]]:
    """The words of a text with their numbers; a letter is deleted where the modulus divides the checksum of document and run."""
    found = Counter(_RUN.findall(text.lower().decode()))  # lower() of bytes changes A-Z alone
    raw = "\n".join(found).encode().split(b"\n")
    base = crc32(f"{'' if doc is None else doc}:".encode())
    for (word, n), h in zip(found.items(), map(crc32, raw, repeat(base))):
        if h % modulus == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def vocabulary(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, modulus: int = MODULUS,
) -> DataFrame:
    """(word, n) of all words with at least `letters` code points and `occurrences` occurrences in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return found

        for batch in pieces(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for word, n in runs(doc, text or b"", modulus):
                    if len(word) >= letters:
                        total[word] += n
            if len(total) > COUNTED:
                yield rows()
        yield rows()

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# ---- keys ---------------------------------------------------------------------------------------------------------------


def _halves(rows: DataFrame) -> DataFrame:
    """Each row's interval [lo, hi) cut in two, with the prefix and suffix that its halves imply."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    cut = rows.withColumn("mid", mid)
    both = F.array(F.struct(F.col("lo"), F.col("mid").alias("hi")), F.struct(F.col("mid").alias("lo"), F.col("hi")))
    halves = cut.select("word", "n", "m", F.explode(both).alias("part")).select("word", "n", "m", "part.lo", "part.hi")
    return halves.select("*", F.substr("word", F.lit(1), F.col("lo")).alias("prefix"), F.expr("right(word, greatest(0, m - hi))").alias("suffix"))


_KEY = ["m", "lo", "hi", "prefix", "suffix"]


def keys(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, m, lo, hi, prefix, suffix): the keys of each word; none has more than `group` words unless one place is left."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size - 1, size)).alias("m")).select("*", F.lit(0).alias("lo"), (F.col("m") + 1).alias("hi"))
    done = None
    rows = written(_halves(rows), "spelling")
    while True:
        large = rows.groupBy(*_KEY).count().where((F.col("count") > group) & (F.col("hi") - F.col("lo") > 1)).select(*_KEY)
        large = written(large, "spelling")  # at most (rows / group) keys
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, _KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = written(_halves(rows.join(large, _KEY, "left_semi")), "spelling")


# ---- bit-sliced index ------------------------------------------------------------------------------------------------------


def _sets(member: np.ndarray, width: int) -> np.ndarray:
    """Rows of booleans as bit sets of 64-bit words."""
    out = np.zeros((member.shape[0], width * 8), np.uint8)
    packed = np.packbits(member, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def neighbours(words: list[str], group: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), sorted by i, of words of one group (rows of a group are adjacent) at distance one whose shorter word has m
    letters and whose first difference lies in [lo, hi).
    """
    count, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    first = np.cumsum(size) - size
    letters, flat = np.unique(flat, return_inverse=True)
    width = -(-count // 64)
    longest = int(size.max())

    def places(i: int) -> tuple[np.ndarray, np.ndarray]:
        """For the place i: a bit set for each letter and one without members for 'no letter', and each word's row in them."""
        code = np.full(count, len(letters))
        if i >= 0:
            inside = i < size
            code[inside] = flat[first[inside] + i]
        here, row = np.unique(code, return_inverse=True)
        member = here[:, None] == code[None, :]
        member[here == len(letters)] = False
        return _sets(member, width), row, here, code

    def matches(index, code: np.ndarray) -> np.ndarray:
        """For each word the set of words that have its letter `code` at the index's place."""
        sets, _, here, _ = index
        at = np.minimum(np.searchsorted(here, code), len(here) - 1)
        found = sets[at]
        found[here[at] != code] = 0
        return found

    zero = np.uint64(0)
    every = ~zero

    def when(condition: np.ndarray) -> np.ndarray:
        return np.where(condition, every, zero)[:, None]

    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    mates = _sets(np.repeat(np.arange(len(starts)), np.diff([*starts, count]))[None, :] == np.arange(len(starts))[:, None], width)
    equal = mates[np.repeat(np.arange(len(starts)), np.diff([*starts, count]))]  # zero errors: the words of the group
    replaced = np.zeros_like(equal)
    longer = np.zeros_like(equal)
    shorter = np.zeros_like(equal)
    of_size = {n: _sets((size == n)[None, :], width)[0] for n in {*size.tolist(), *(size + 1).tolist(), *(size - 1).tolist()}}
    result = np.zeros_like(equal)
    short, long = size == m, size == m + 1
    before, now, after = places(-1), places(0), places(1)
    for i in range(longest + 1):
        ends = size == i
        if ends.any():  # here a word's letters are used up; what stands now is its result
            at = np.flatnonzero(ends)
            same, next_up = of_size[i][None, :], of_size[i + 1][None, :]
            more = longer[at] | equal[at] & when((lo[at] <= i) & (i < hi[at]))
            result[at] = when(short[at]) & (replaced[at] & same | more & next_up)
            if i and (i - 1) in of_size:
                result[at] |= when(long[at]) & shorter[at] & of_size[i - 1][None, :]
        if i == longest:
            break
        code = now[3]
        hit = matches(now, code)
        miss = equal & ~hit & when((lo <= i) & (i < hi) & (i < size))
        replaced = replaced & hit | miss
        longer = (longer | miss) & matches(after, code)
        shorter = shorter & matches(before, code) | miss
        equal = equal & hit
        before, now, after = now, after, places(i + 2)
    bits = np.unpackbits(result.view(np.uint8), axis=1, count=count, bitorder="little")
    return np.nonzero(bits)


def link(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best): from each key of a word, the number of its neighbours there and the most frequent one."""
    schema = "word string, n_near long, best_n long, best string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def results(rows: list[tuple]) -> pa.RecordBatch:
            words, n, m, lo, hi = (list(c) for c in zip(*(r[:5] for r in rows)))
            group = np.cumsum([0, *(a[2:] != b[2:] for a, b in zip(rows, rows[1:]))])
            of, near = neighbours(words, group, *(np.array(x, np.int64) for x in (m, lo, hi)))
            found: dict[int, list] = {}
            for i, j in zip(of.tolist(), near.tolist()):
                best = found.setdefault(i, [0, -1, ""])
                best[0] += 1
                if n[j] > best[1] or n[j] == best[1] and words[j] < best[2]:
                    best[1:] = n[j], words[j]
            columns = list(zip(*((words[i], *best) for i, best in found.items()))) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

        key: list[tuple] = []  # the rows of the last key; a word alone in its key has no neighbour there
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if key and row[2:] != key[-1][2:]:
                    rows += key if len(key) > 1 else []
                    key = []
                    if len(rows) >= block:
                        yield results(rows)
                        rows = []
                key.append(row)
        rows += key if len(key) > 1 else []
        if rows:
            yield results(rows)

    return keyed.select("word", "n", *_KEY).repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, schema)


# ---- forms --------------------------------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word on the way along the forms. The way doubles in each round; counts grow along it by `TIMES`
    at least, so it has no circle and the rounds are few.
    """
    steps = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        next_up = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        steps = written(steps.join(next_up, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")


def variants(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES,
    times: int = TIMES, modulus: int = MODULUS, group: int = GROUP, block: int = BLOCK,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the corpus: its most frequent near word (ties: the smaller word) if
    that is `times` as frequent, the last word along the forms, and the number of near words.

    A null or empty text has no word, a null id counts as empty text, a run of letters of any length is one word, repeated rows
    count again, an empty table gives an empty result, other columns are not read. Orders of words are by code points.
    """
    words = written(vocabulary(docs, id_column, text_column, letters, occurrences, modulus), "words")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))  # the largest number, then the smallest word
    near = link(keys(words, group), block).groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top"))
    linked = words.join(near, "word", "left")
    good = -F.col("top.less") >= times * F.col("n")
    forms = written(
        linked.select(
            "word", "n", F.when(good, F.col("top.best")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(good, -F.col("top.less")).alias("form_n"),
        ),
        "forms",
    )
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
