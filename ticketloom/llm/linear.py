"""Sparse multinomial logistic regression, trained by follow-the-regularised-leader on a bounded sample in parallel shards.

Every shard runs FTRL-Proximal with elastic-net penalties over its documents; the shards' weights are averaged by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

SHARDS = 8
#: One document's features: buckets (each once) and values.
Features = tuple[np.ndarray, np.ndarray]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[Features], labels: np.ndarray, buckets: int, classes: int,
    alpha: float, beta: float, l1: float, l2: float, epochs: int,
) -> np.ndarray:
    """Weights [buckets + 1, classes]; the last row is the bias."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at, x = np.append(rows[i][0], buckets), np.append(rows[i][1], 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            error = softmax(x @ w)
            error[labels[i]] -= 1.0
            g = x[:, None] * error
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    return weights(z, n)


def train(
    sample: DataFrame, features: Callable[[list[str]], list[Features]], buckets: int, classes: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3,
) -> np.ndarray:
    """Average weights of the shards of `sample` (id, text, label from 0). The sample is bounded by the caller; what comes to
    the driver is the model, at most (buckets + 1) * classes numbers. Without rows all weights are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, Features]] = []
        for batch in batches:
            rows += zip(column(batch, "key"), column(batch, "label"), features(column(batch, "text")))
        if rows:
            rows.sort(key=lambda r: r[0])  # the same order in a repeated task
            w = ftrl([r[2] for r in rows], np.array([r[1] for r in rows]), buckets, classes, alpha, beta, l1, l2, epochs)
            at, k = np.nonzero(w)
            at, k, v = np.append(at, -1), np.append(k, 0), np.append(w[at, k], 1.0)  # -1 counts the shards
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(k, pa.int32()), pa.array(v)], ["at", "class", "w"])

    dealt = sample.select(F.xxhash64("id", "text").alias("key"), "text", "label").repartition(SHARDS, "key")
    rows = dealt.mapInArrow(run, "at int, class int, w double").groupBy("at", "class").agg(F.sum("w").alias("w")).collect()
    weights = np.zeros((buckets + 1, classes))
    shards = 1.0
    for at, k, w in rows:
        if at < 0:
            shards = w
        else:
            weights[at, k] = w
    return weights / shards


def class_sample(rows: DataFrame, label: str, bound: int) -> tuple[DataFrame, list, list[float]]:
    """About `bound` rows of each class, chosen by a hash of the id: (sample, classes, share of each class's rows taken)."""
    counts = sorted((r[0], r[1]) for r in rows.groupBy(label).count().collect())
    shares = [min(1.0, bound / n) for _, n in counts]
    taken = F.lit(False)
    number = F.lit(None).cast("int")
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    for i, ((name, _), share) in enumerate(zip(counts, shares)):
        is_class = F.col(label) == F.lit(name)
        taken = taken | (is_class & (draw < int(share * (1 << 30))))
        number = F.when(is_class, F.lit(i)).otherwise(number)
    return rows.where(taken).withColumn("label", number), [name for name, _ in counts], shares
