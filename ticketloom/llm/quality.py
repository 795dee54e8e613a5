"""Quality rules: fixed counts of each text, and a hashed n-gram logistic regression for what passes them.

The counts need no model. The verdict comes from a logistic regression on hashed words, word pairs and character n-grams of
one to three code points of the whole text, fitted on at most `SAMPLE` labelled rows of each class (an expected number;
rows are drawn by a hash of their id), a fifth of which are kept back to calibrate the probability, weighted back to the classes'
true shares. Texts are scored in Arrow batches; a text is kept if its probability of quality reaches `THRESHOLD`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, linear
from .common import SPACES, column, pieces

SAMPLE = 2000
LONGEST = 3
SCALE = 30.0
THRESHOLD = 0.5
#: Fixed rules: fewer words fail, and a larger share of words in repeated windows fails.
LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED = 20  # per cent
SYMBOLS = "#*$%&|<>"


# ---- counts -------------------------------------------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a WINDOW-word window found twice or more in the text."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    change = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(np.fromiter((count[w] > 1 for w in windows), bool, len(windows)))
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(change)))


def counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. A null text has no words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # cuts at exactly the six characters of SPACES
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    n, again = len(words), repeated_words(words)
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again,
        n < LEAST_WORDS or 100 * again > MOST_REPEATED * n,
    )


# ---- model --------------------------------------------------------------------------------------------------------------


def _grams(texts: list[str | None]) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Character buckets by n, (position, bucket) of words and pairs, starts, and code points of each text."""
    codes, starts = hashing.code_points([t or "" for t in texts])
    grams = [np.where(codes > 0, g, 2 * hashing.BUCKETS) for g in hashing.char_grams(codes, LONGEST)]
    return grams, [(at, g + np.uint32(hashing.BUCKETS)) for at, g in hashing.word_grams(codes, starts)], starts, np.diff(np.append(starts, len(codes))) - hashing.GAP


def features(texts: list[str]) -> list[linear.Features]:
    grams, words, starts, size = _grams(texts)
    ends, out = np.append(starts[1:], len(grams[0])), []
    for a, b, n in zip(starts, ends, size):
        found = [g[a:b] for g in grams]
        for at, g in words:
            found.append(g[np.searchsorted(at, a) : np.searchsorted(at, b)])
        count = np.bincount(np.concatenate(found), minlength=2 * hashing.BUCKETS + 1)[:-1]
        at = np.flatnonzero(count)
        out.append((at, SCALE * count[at] / max(n, 1)))
    return out


def margins(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds before calibration. table: a weight for each bucket, with a last 0."""
    grams, words, starts, size = _grams(texts)
    value = np.zeros(len(grams[0]))
    for g in grams:
        value += table[g]
    for at, g in words:
        value[at] += table[g]
    return SCALE * hashing.per_text(value, starts) / np.maximum(size, 1) + bias


def platt(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability, by Newton steps on smoothed targets."""
    if not len(margin):
        return 1.0, 0.0
    right, wrong = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (right + 1) / (right + 2), 1 / (wrong + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    theta = np.array([0.0, np.log((right + 1) / (wrong + 1))])

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 1e-6 * (t @ t))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        slope = x.T @ (weight * (p - target)) + 2e-6 * theta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(theta - size * step) > loss(theta) and size > 1e-6:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


class Model:
    """The fitted classifier. Without labelled rows, or with one class alone, every text has probability 1."""

    def __init__(self, table: np.ndarray | None, bias: float = 0.0, slope: float = 1.0, offset: float = 0.0):
        self.table, self.bias, self.slope, self.offset = table, bias, slope, offset

    def probability(self, texts: list[str | None]) -> np.ndarray:
        if self.table is None or not texts:
            return np.ones(len(texts))
        z = self.slope * margins(texts, self.table, self.bias) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: id, text; labels: id, class (0 or 1). Null texts or classes teach nothing."""
    known = labels.where("id IS NOT NULL AND class IS NOT NULL")
    drawn, classes, shares = linear.class_sample(known, "class", sample)
    if len(classes) < 2:
        return Model(None)
    # at most about 2 * sample ids, so this side's size is bounded
    rows = docs.where("text IS NOT NULL").join(F.broadcast(drawn.select("id", "label")), "id").select("id", "text", "label")
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(5)) == 0
    weights = linear.train(rows.where(~held), features, 2 * hashing.BUCKETS, 2, l1=0.0, l2=0.1)
    table = np.zeros(2 * hashing.BUCKETS + 1, np.float32)
    table[:-1] = weights[:-1, 1] - weights[:-1, 0]
    bias = float(weights[-1, 1] - weights[-1, 0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(margins(column(batch, "text"), table, bias)), batch.column(1)], ["margin", "label"])

    # a fifth of the bounded sample, two numbers a row
    held_rows = rows.where(held).select("text", "label").mapInArrow(score, "margin double, label int").collect()
    label = np.array([r.label for r in held_rows], int)
    weight = np.array([1 / shares[k] for k in label])
    return Model(table, bias, *platt(np.array([r.margin for r in held_rows]), label, weight))


def judge(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept) of each row.

    Null and empty texts have no words and fail. Repeated rows give repeated results, an empty table an empty result; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = column(batch, "text")
            found = list(zip(*map(counts, texts)))
            p = model.probability(texts)
            failed = np.array(found[5])
            numbers = [pa.array(c, pa.int64()) for c in found[:5]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers, pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, {schema}")
