"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel compares two words by the subsequences of three letters that they share, gaps included: an occurrence that passes over
g letters counts GAP**g, up to MOST_GAPS. So an insult with letters put in or left out stays close to the plain one. Words that are
spelled out letter by letter are read together, and signs inside a word are passed over.

A text is as toxic as its most toxic word. The machine learns from words of labelled texts: of a toxic text the word that speaks
most for toxicity (first by its odds over the labelled texts, then by the machine itself), of clean texts a sample of words,
and then those that the machine takes for toxic. Landmarks are the words most typical of either side. As the decision is linear
in the subsequences, it is folded into one table of their weights, with which all words of all texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import column, pieces, written
from .quality import platt

GAP, MOST_GAPS = 0.5, 3
LETTERS = 64
SPAN = 24  # longer words are read in overlapping parts of this length
#: Bounds of the fit: labelled texts of each class, words of each side, landmarks of each side.
SAMPLE, WORDS, LANDMARKS = 4000, 6000, 256
ROUNDS = 3
PARTS = 5  # of the labelled texts, for the calibration
PENALTY = 1e-5
#: A word whose likelihood ratio for the toxic side exceeds this stands for toxicity in any text.
SURE = 18.0
THRESHOLD = 0.7
_STEPS = [(a, b) for a in range(1, MOST_GAPS + 2) for b in range(1, MOST_GAPS + 3 - a)]


# ---- words --------------------------------------------------------------------------------------------------------------


def _plain(token: str) -> str:
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def units(text: str | None) -> set[str]:
    """The distinct words of a text in lower case, letters only, and runs of three or more single letters as one word."""
    tokens = (text or "").lower().split()
    found = set(tokens)
    single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
    if np.count_nonzero(single) >= 3:
        edge = np.flatnonzero(np.diff(single.astype(np.int8), prepend=0, append=0))
        found.update("".join(tokens[a:b]) for a, b in zip(edge[::2], edge[1::2]) if b - a >= 3)
    return found


@cache
def _table() -> np.ndarray:
    """A code from 1 to 63 for each code point: a-z, word start and end apart, other letters by their number."""
    table = 29 + np.arange(0x110000) % 35
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table.astype(np.uint8)


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of letter codes between start and end marks, padded with 0, and the word that each row is a part of."""
    parts, owner = [], []
    for k, word in enumerate(map(_plain, words)):
        if len(word) <= SPAN:
            parts.append(word)
            owner.append(k)
        else:
            some = [word[a : a + SPAN] for a in range(0, len(word) - SPAN // 2, SPAN // 2)]
            parts += some
            owner += [k] * len(some)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    rows = np.zeros((len(parts), SPAN + 2), np.uint8)
    letters = _table()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    first = np.cumsum(size) - size
    rows[np.repeat(np.arange(len(parts)), size), np.arange(len(letters)) - np.repeat(first, size) + 1] = letters
    rows[:, 0] = 27
    rows[np.arange(len(parts)), size + 1] = 28
    return rows, np.array(owner, np.int64)


def subsequences(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(code of each subsequence, whether it lies in the word, weight) for each pair of steps, over all rows at once."""
    wide = rows.astype(np.int32)
    for a, b in _STEPS:
        if (end := wide.shape[1] - a - b) > 0:
            third = wide[:, a + b :]
            yield wide[:, :end] * LETTERS**2 + wide[:, a : a + end] * LETTERS + third, third > 0, GAP ** (a + b - 2)


def lengths(rows: np.ndarray) -> np.ndarray:
    """The norm by which a word's kernel values are divided; it depends on the number of letters alone."""
    total = np.zeros(len(rows))
    for _, inside, weight in subsequences(rows):
        total += weight**2 * inside.sum(axis=1)
    return np.sqrt(np.maximum(total, 1e-9))


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel values of words against landmarks."""
    place = np.zeros(LETTERS**3, np.int32)
    used = np.unique(np.concatenate([c[i] for c, i, _ in subsequences(landmarks)]))
    place[used] = np.arange(1, len(used) + 1)
    side = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    number = np.broadcast_to(np.arange(len(landmarks))[:, None], landmarks.shape)
    for code, inside, weight in subsequences(landmarks):
        np.add.at(side, (place[code[inside]], number[:, : code.shape[1]][inside]), weight)
    side /= lengths(landmarks)
    out = np.zeros((len(rows), len(landmarks)), np.float32)
    for at in range(0, len(rows), 64):
        part = rows[at : at + 64]
        for code, inside, weight in subsequences(part):
            known = np.where(inside, place[code], 0)
            row, col = np.nonzero(known)
            if len(row):  # sums of each row's landmarks; rows come in order
                first = np.flatnonzero(np.diff(row, prepend=-1))
                out[at + row[first]] += weight * np.add.reduceat(side[known[row, col]], first, axis=0)
    return out / lengths(rows)[:, None]


def fold_weights(landmarks: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights of all subsequences whose sum over a word, by its length, is the shares' sum of kernel values."""
    table = np.zeros(LETTERS**3)
    scaled = share / lengths(landmarks)
    for code, inside, weight in subsequences(landmarks):
        np.add.at(table, code[inside], weight * np.broadcast_to(scaled[:, None], code.shape)[inside])
    return table.astype(np.float32)


def margins(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value of each word; of a long word the largest of its parts."""
    if not words:
        return np.zeros(0)
    rows, owner = encode(words)
    size = np.count_nonzero(rows, axis=1)
    value = np.empty(len(rows))
    order = np.argsort(size, kind="stable")
    for at in range(0, len(order), 8192):  # words of like length, so that little of a row is padding
        pick = order[at : at + 8192]
        part = rows[pick, : max(3, int(size[pick[-1]]))]
        total = np.zeros(len(pick), np.float32)
        for code, inside, weight in subsequences(part):
            total += weight * np.where(inside, table[code], 0).sum(axis=1)
        value[pick] = total / lengths(part)
    best = np.full(len(words), -np.inf)
    np.maximum.at(best, owner, value)
    return best + bias


# ---- fit ----------------------------------------------------------------------------------------------------------------


def machine(z: np.ndarray, side: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    x = np.column_stack([z, np.ones(len(z))]).astype(np.float32)
    blocks = [slice(at, at + 1024) for at in range(0, len(x), 1024)]  # of rows, so that no second copy of all is made
    ridge = PENALTY * weight.sum() * np.eye(x.shape[1])
    ridge[-1, -1] *= 1e-3
    w = np.zeros(x.shape[1])
    inside = np.ones(len(x), bool)
    for _ in range(30):
        left, right = ridge.copy(), np.zeros(len(w))
        for block in blocks:
            pick = inside[block]
            some = x[block][pick].astype(np.float64)
            weighted = some * weight[block][pick, None]
            left += weighted.T @ some
            right += weighted.T @ side[block][pick]
        w = np.linalg.solve(left, right)
        now = side * np.concatenate([x[block] @ w for block in blocks]) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


class Model:
    """The fitted scorer. Without both classes among the labels every text has score 0."""

    def __init__(self, table: np.ndarray | None = None, bias: float = 0.0, slope: float = 1.0, offset: float = 0.0):
        self.table, self.bias, self.slope, self.offset = table, bias, slope, offset

    def margin(self, texts: list[str | None]) -> np.ndarray:
        """The largest value of a text's words; a text without words has the value of an empty word."""
        found = [units(t) for t in texts]
        words = list(set().union(*found))
        known = dict(zip(words, margins(words, self.table, self.bias).tolist()))
        return np.array([max(map(known.__getitem__, f), default=self.bias) for f in found])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.table is None or not texts:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(texts) + self.offset, -40, 40)))


def learn(spoken: DataFrame) -> Model:
    """spoken: (id, label, word) of labelled texts. The machine alone, with its margins not yet calibrated."""
    texts = dict(spoken.groupBy("label").agg(F.countDistinct("id")).collect())
    if len(texts) < 2:
        return Model()
    counted = spoken.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    share = texts[1] / (texts[0] + texts[1])
    seen, toxic, clean_ = F.col("toxic") + F.col("clean"), F.col("toxic"), F.col("clean")
    ratio = 2 * (toxic * F.log(F.greatest(toxic, F.lit(0.5)) / (seen * share)) + clean_ * F.log(F.greatest(clean_, F.lit(0.5)) / (seen * (1 - share))))
    # likelihood ratio of the word's split between the classes, negative where it leans to the clean side
    counted = written(counted.withColumn("odds", F.when(toxic > seen * share, 1).otherwise(-1) * ratio), "word_odds")
    few = [F.xxhash64("word"), F.col("word")]
    # common words may lean to the toxic side a little, as toxic texts may be the longer ones; that does not make them insults
    clean = dict(counted.where("clean >= toxic").orderBy(*few).select("word", "clean").limit(WORDS).collect())
    common = dict(counted.where("clean >= toxic").orderBy(F.desc("clean"), *few).select("word", "clean").limit(LANDMARKS).collect())
    clean |= common
    witnesses = spoken.where("label = 1").join(counted.where("clean < toxic"), "word").groupBy("id").agg(F.max_by("word", F.struct("odds", "word")).alias("word"))
    speak = dict(witnesses.groupBy("word").count().orderBy(F.desc("count"), *few).limit(WORDS).collect())
    sure = dict(counted.where("clean < toxic").where(F.col("odds") > SURE).orderBy(F.desc("odds"), *few).select("word", "toxic").limit(WORDS).collect())
    speak |= sure
    typical = [r[0] for r in counted.where("clean < toxic AND toxic > 1").orderBy(F.desc("odds"), *few).limit(LANDMARKS).collect()]
    near: dict[str, int] = {}  # clean words that the machine took for toxic

    model = Model()
    for turn in range(ROUNDS):
        landmarks, _ = encode(list(dict.fromkeys([*(typical or speak), *common, *list(near)[:LANDMARKS]])))
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
        good = values > 1e-4 * values[-1]
        root = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)  # the Nyström map: kernel values times root
        sides = [speak, {w: n for w, n in clean.items() if w not in speak}, {w: n for w, n in near.items() if w not in speak}]
        words = [w for part in sides for w in part]
        side = np.where(np.arange(len(words)) < len(speak), 1.0, -1.0)
        roots = [np.sqrt([1 + n for n in part.values()]) for part in sides if part]
        w, bias = machine(kernel(encode(words)[0], landmarks) @ root, side, np.concatenate([r / r.sum() for r in roots]))
        model = Model(fold_weights(landmarks, root @ w), bias)
        if turn == ROUNDS - 1:
            break
        valued = written(counted.select("word", "clean", "toxic").mapInArrow(partial(_valued, model=model), "word string, clean long, toxic long, value double"), "word_values")
        # a text without a known insult must not make a common word its witness
        best = spoken.where("label = 1").join(valued.where("clean < toxic"), "word").groupBy("id").agg(F.max_by("word", F.struct("value", "word")).alias("word"))
        speak = dict(best.groupBy("word").count().orderBy(F.desc("count"), *few).limit(WORDS).collect()) | sure
        wrong = valued.where("clean >= toxic AND value > -0.8").orderBy(F.desc("value"), *few).select("word", "clean").limit(WORDS // 2).collect()
        near |= dict(wrong)

    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: id, text; labels: id, class (1: toxic). Null texts or classes teach nothing.

    The machine learns from all drawn texts. Its calibration is cross-fitted: each of PARTS parts is valued by a machine that
    learnt from the other parts, so every drawn text counts, however few of them are toxic.
    """
    drawn, classes, shares = linear.class_sample(labels.where("id IS NOT NULL AND class IS NOT NULL"), "class", sample)
    if len(classes) < 2:
        return Model()

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1_000_000):
            found = [sorted({p for w in units(t) if (p := _plain(w)) and len(p) <= SPAN}) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.string()))], ["id", "part", "label", "words"])

    # at most about 2 * sample ids, so this side's size is bounded
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part")
    rows = docs.where("text IS NOT NULL").join(F.broadcast(drawn.select("id", "label")), "id").select("id", part, "label", "text")
    kind = docs.schema["id"].dataType.simpleString()
    said = rows.mapInArrow(words_of, f"id {kind}, part int, label int, words array<string>")
    spoken = written(said.select("id", "part", "label", F.explode("words").alias("word")), "words")
    model = learn(spoken)
    if model.table is None:
        return model
    others = [learn(spoken.where(F.col("part") != k)) for k in range(PARTS)]  # one after the other: the driver holds one fit's arrays

    def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            text, part = column(batch, "text"), np.array(column(batch, "part"))
            value = np.full(len(text), np.nan)
            for k, other in enumerate(others):
                if other.table is not None and len(at := np.flatnonzero(part == k)):
                    value[at] = other.margin([text[i] for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(value), batch.column(1)], ["margin", "label"])

    # two numbers for each row of the bounded sample; without both classes in the other parts a text has no value
    tried = rows.select("text", "label", "part").mapInArrow(margin, "margin double, label int").where(~F.isnan("margin")).collect()
    label = np.array([r.label for r in tried], int)
    model.slope, model.offset = platt(np.array([r.margin for r in tried]), label, np.array([1 / shares[k] for k in label]))
    return model


def _valued(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("value", pa.array(margins(batch.column(0).to_pylist(), model.table, model.bias), pa.float64()))


def toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of each row from its whole text alone. Null and empty texts have the score of no word. Repeated rows give
    repeated results, an empty table an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(column(batch, "text")), pa.float64())], ["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, score double")
