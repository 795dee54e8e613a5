"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three letters (other characters count as one space) of the whole text; a text's value
for an n-gram is its share of the text's n-grams times the inverse document frequency, which is counted over all training
rows. The weights are fitted by FTRL with elastic-net penalties on at most `SAMPLE` rows of each language (an expected
number: rows are drawn by a hash of their id), a fifth of which are kept back to fit the temperature of the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, linear
from .common import column, pieces

#: Training rows of each language that the weights are fitted on.
SAMPLE = 2000
LONGEST = 3
SCALE = 30.0
UNKNOWN = "und"
TEMPERATURES = np.geomspace(0.05, 5.0, 60)


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        if (c := chr(code)).isalpha():
            table[code] = ord(c.lower()[0])
    table[0] = 0
    return table


def _grams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Buckets by n, starts, number of n-grams of each text, and whether it has a letter."""
    codes, starts = hashing.code_points([t or "" for t in texts])
    known = _letters()[codes]
    letters = hashing.per_text((known > 32).astype(np.int64), starts)
    blank = np.zeros(len(known), bool)
    blank[1:] = (known[1:] == 32) & (known[:-1] == 32)
    filled = known != 0
    grams = hashing.char_grams(known, LONGEST)
    valid = filled & ~blank  # one n-gram of a run of spaces is enough
    return [np.where(valid, g, hashing.BUCKETS) for g in grams], starts, hashing.per_text(valid.astype(np.int64), starts) * LONGEST, letters > 0


def features(texts: list[str], idf: np.ndarray) -> list[linear.Features]:
    grams, starts, total, _ = _grams(texts)
    ends, out = np.append(starts[1:], len(grams[0])), []
    for a, b, n in zip(starts, ends, total):
        count = np.bincount(np.concatenate([g[a:b] for g in grams]), minlength=hashing.BUCKETS + 1)[:-1]
        at = np.flatnonzero(count)
        out.append((at, SCALE * count[at] / max(n, 1) * idf[at]))
    return out


def logits(texts: list[str | None], table: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class scores of each text, and whether it has a letter. table: weights times idf, with a last row of zeros."""
    grams, starts, total, lettered = _grams(texts)
    score = np.zeros((len(texts), table.shape[1]))
    for g in grams:
        score += hashing.per_text(table[g], starts)
    return SCALE * score / np.maximum(total, 1)[:, None] + bias, lettered


def document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows: the number of texts with each bucket, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, texts = np.zeros(hashing.BUCKETS + 1, np.int64), 0
        for batch in pieces(batches):
            grams, starts, _, _ = _grams(column(batch, "text"))
            texts += len(starts)
            for a, b in zip(starts, np.append(starts[1:], len(grams[0]))):
                seen = np.zeros(hashing.BUCKETS + 1, bool)
                for g in grams:
                    seen[g[a:b]] = True
                df += seen
        df[-1] = texts
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["at", "df"])

    df = np.zeros(hashing.BUCKETS + 1, np.int64)
    for at, n in rows.select("text").mapInArrow(run, "at int, df long").groupBy("at").agg(F.sum("df")).collect():
        df[at] = n
    return df[:-1], int(df[-1])


class Model:
    """The fitted classifier; `languages` may be empty, and then every text is `und`."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        z, lettered = logits(texts, self.table, self.bias)
        p = linear.softmax(z / self.temperature)
        best = p.argmax(axis=1)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
        return names, np.where(lettered, p[np.arange(len(texts)), best], 0.0)


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on rows (id, text, lang). Rows with a null text or language teach nothing; one language or none is allowed."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    drawn, languages, _ = linear.class_sample(rows, "lang", sample)
    if not languages:
        return Model([], np.zeros((hashing.BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0)
    df, texts = document_frequency(rows)
    idf = np.log((1 + texts) / (1 + df)) + 1
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(5)) == 0
    weights = linear.train(drawn.where(~held), partial(features, idf=idf), hashing.BUCKETS, len(languages))
    table = np.zeros((hashing.BUCKETS + 1, len(languages)), np.float32)
    table[:-1] = weights[:-1] * idf[:, None]
    model = Model(languages, table, weights[-1], 1.0)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            z, _ = logits(column(batch, "text"), table, weights[-1])
            label = np.array(column(batch, "label"))
            loss = [-np.log(np.maximum(linear.softmax(z / t)[np.arange(len(label)), label], 1e-12)).sum() for t in TEMPERATURES]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(loss)), pa.int32()), pa.array(loss)], ["t", "loss"])

    loss = dict(drawn.where(held).select("text", "label").mapInArrow(losses, "t int, loss double").groupBy("t").agg(F.sum("loss")).collect())
    if loss:
        model.temperature = float(TEMPERATURES[min(loss, key=loss.get)])
    return model


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row, from its whole text alone. A null text or one without a letter is `und` with
    score 0. Repeated rows give repeated results; an empty table gives an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, score = model.predict(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def confident(docs: DataFrame, model: Model, least: float, text_column: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, whose language is known with at least this probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_column):
            names, score = model.predict(column(batch, text_column))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
