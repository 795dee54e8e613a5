"""Multiclass gradient boosting with a softmax loss, fitted by histograms that Spark sums.

Features are cut at quantiles into at most `BINS` bins, once. A round grows one tree a class, level by level: every task adds
up gradient and curvature for each (tree, node, feature, bin) it meets, one aggregation sums these cells over all tasks, and the
best cut of each node is found where the node's cells meet (at most features x bins of them, whatever the number of rows). The
driver sees one row for each node of a level. Several depths are grown side by side in the same jobs.

The rows' scores are not carried from job to job: a task computes them from the trees grown since the rows were last written,
which happens every `KEEP` rounds. A lost task or executor costs that much work again and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed

BINS = 16
KEEP = 10  # rounds between two writes of the rows with their scores
SLICE = 2000  # rows of a matrix in a task
RATE, SHRINK, LEAST_CURVATURE, LEAST_GAIN = 0.3, 1.0, 1e-3, 1e-6
PATIENCE, TOLERANCE = 3, 1e-3


@dataclass
class Tree:
    """Nodes numbered as in a heap: the children of node i are 2i + 1 (bin up to `cut`) and 2i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def of_depth(depth: int) -> Tree:
        size = (1 << (depth + 1)) - 1
        return Tree(np.full(size, -1, np.int32), np.zeros(size, np.float64), np.zeros(size))

    def place(self, matrix: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node, rows = np.zeros(len(matrix), np.int64), np.arange(len(matrix))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            right = matrix[rows, np.maximum(feature, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)


@dataclass
class Grown:
    """What has been grown for one depth: rounds of one tree a class, and the losses that decide when to stop."""

    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    open: bool = True

    def judge(self, loss: float) -> None:
        """Record the loss of the validation rows with all rounds so far; stop when it has not improved for `PATIENCE` rounds."""
        self.losses.append(loss)
        best = min(self.losses[:-PATIENCE], default=np.inf)
        self.open = len(self.losses) <= PATIENCE or min(self.losses[-PATIENCE:]) < best - TOLERANCE

    def best(self) -> list[list[Tree]]:
        """The rounds up to the least loss, one at least: without a tree all classes are alike."""
        return self.rounds[: max(1, int(np.argmin(self.losses)))] if self.losses else self.rounds


# ---- bins -----------------------------------------------------------------------------------------------------------------


def sparse(vector: Column) -> list[Column]:
    """What `grow` takes of a column of ML vectors: `places` and `numbers` of the values it holds, and `size`."""
    v = F.unwrap_udt(vector)
    every = F.transform(v["values"], lambda _, i: i)
    return [F.coalesce(v["indices"], every).alias("places"), v["values"].alias("numbers"), F.coalesce(v["size"], F.size(v["values"])).alias("size")]


def _listed(vectors: DataFrame) -> DataFrame:
    """Rows with `values` as rows with `places`, `numbers` and `size`."""
    if "values" not in vectors.columns:
        return vectors
    every = F.transform("values", lambda _, i: i)
    return vectors.select(every.alias("places"), F.col("values").alias("numbers"), F.size("values").alias("size"), *[c for c in vectors.columns if c != "values"])


def bin_edges(vectors: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Ascending cuts of each feature, at quantiles of its values other than zero: a value's bin is the number of cuts below it.

    The driver sees at most `bins` - 1 numbers a feature.
    """
    vectors = _listed(vectors)
    size = vectors.select("size").first()
    edges = [np.zeros(0)] * (size[0] if size else 0)
    nonzero = vectors.select(F.inline(F.arrays_zip("places", "numbers")).alias("feature", "value")).where("value <> 0")
    cuts = [k / (bins - 1) for k in range(1, bins - 1)]
    found = nonzero.groupBy("feature").agg(F.percentile_approx("value", cuts, 1000).alias("cuts"), F.min("value").alias("least"), F.max("value").alias("most"))
    for feature, inner, least, most in found.collect():
        # zero and the smallest positive value fall apart, and so do the largest negative value and zero
        points = np.unique([*inner, 0.0, least / 2 if least > 0 else least]) if most > 0 else np.unique([*inner, most / 2])
        edges[feature] = points[points < max(most, 0.0)][-(bins - 1) :] if len(points) else points
    return edges


def _bins_of(feature: np.ndarray, value: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of cuts of its feature below each value; all of them for a value that is no number."""
    table = np.full((max(map(len, edges), default=0), len(edges)), np.nan)
    for f, own in enumerate(edges):
        table[: len(own), f] = own
    found, none = np.zeros(len(value), np.int32), np.isnan(value)
    for cut in table:
        found += cut[feature] < value
    found[none] = np.array([len(own) for own in edges], np.int32)[feature[none]]
    return found


def _binned(vectors: DataFrame, edges: list[np.ndarray], keep: Sequence[str]) -> DataFrame:
    """The rows with `features` and `bins` of the values other than zero."""
    vectors = _listed(vectors)
    kinds = dict(vectors.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            feature, value = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            there = value != 0
            row = np.repeat(np.arange(batch.num_rows), batch.column(0).value_lengths().to_numpy())[there]
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            feature = feature[there].astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (feature, _bins_of(feature, value[there], edges))]
            yield pa.RecordBatch.from_arrays([*lists, *batch.columns[2:]], ["features", "bins", *keep])

    schema = "features array<int>, bins array<int>, " + ", ".join(f"{c} {kinds[c]}" for c in keep)
    return vectors.select("places", "numbers", *keep).mapInArrow(cut, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _asked(grown: list[list[list[Tree]]], growing: dict[int, Tree], size: int) -> tuple[np.ndarray, list[list[list[Tree]]], dict[int, Tree]]:
    """The features that some tree asks for, and the trees with features numbered among these."""
    trees = [*(t for rounds in grown for own in rounds for t in own), *growing.values()]
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *[t.feature[t.feature >= 0] for t in trees]]).astype(np.int64))
    number = np.zeros(size + 1, np.int32)
    number[used], number[-1] = np.arange(len(used)), -1
    own = lambda t: Tree(number[t.feature], t.cut, t.value)
    return used, [[[own(t) for t in trees] for trees in rounds] for rounds in grown], {k: own(t) for k, t in growing.items()}


def _matrix(batch: pa.RecordBatch, zero: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the used features (rows x features), the number of values other than zero of each row, their features and bins."""
    lists = batch.column(0)
    size = lists.value_lengths().to_numpy()
    feature, bin_ = lists.flatten().to_numpy(), batch.column(1).flatten().to_numpy()
    number = np.full(len(zero), -1)
    number[used] = np.arange(len(used))
    column = number[feature]
    there = column >= 0
    matrix = np.tile(zero[used].astype(np.uint8), (batch.num_rows, 1)) if len(used) else np.zeros((batch.num_rows, 1), np.uint8)
    matrix[np.repeat(np.arange(batch.num_rows), size)[there], column[there]] = bin_[there]
    return matrix, size, feature, bin_


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _scores(batch: pa.RecordBatch, matrix: np.ndarray, grown: list[list[list[Tree]]], classes: int) -> np.ndarray:
    """(rows, depths, classes): the written scores and those of the trees grown since."""
    start = batch.column(5).flatten().to_numpy().reshape(batch.num_rows, len(grown), classes).copy()
    for d, rounds in enumerate(grown):
        for trees in rounds:
            for k, tree in enumerate(trees):
                start[:, d, k] += tree.value[tree.place(matrix)]
    return start


_COLUMNS = ["features", "bins", "y", "weight", "held", "scores"]
_CELL = "tree int, node int, feature int, bin int, g double, h double"


def _cells(rows: DataFrame, grown: list[list[list[Tree]]], growing: dict[int, Tree], level: int, zero: np.ndarray, classes: int) -> DataFrame:
    """Sums of gradient and curvature of each (tree, node, feature, bin); feature -1 holds a node's total, and tree -1 - d the
    loss and weight of the validation rows for depth d. Values of zero are left out: a node's total gives them.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, first, places = 1 << level, (1 << level) - 1, len(zero)
        sums = {t: np.zeros((2, nodes, places * BINS)) for t in growing}
        totals = {t: np.zeros((2, nodes)) for t in growing}
        loss = np.zeros((len(grown), 2))
        used, before, now = _asked(grown, growing, places)
        for batch in _slices(batches):
            matrix, size, feature, bin_ = _matrix(batch, zero, used)
            # the (feature, bin) that occur in the slice, far fewer than there are, and which of them each value is
            within = feature.astype(np.int64) * BINS + bin_
            number = np.zeros(places * BINS, np.int64)
            number[within] = 1
            met = np.flatnonzero(number)
            number[met] = np.arange(len(met))
            within = number[within]
            y, weight, held = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            y = y.astype(np.int64)
            share = softmax(_scores(batch, matrix, before, classes))
            if level == 0:
                own = np.log(np.maximum(share[np.arange(len(y)), :, y], 1e-15)) * np.where(held, weight, 0)[:, None]
                loss += np.stack([-own.sum(axis=0), np.full(len(grown), weight[held].sum())], axis=1)
            use = np.where(held, 0.0, weight)
            for t, tree in now.items():
                p = share[:, t // classes, t % classes]
                node = tree.place(matrix) - first
                inside = (node >= 0) & ~held
                node = np.where(inside, node, 0)
                cell = np.repeat(node * len(met), size) + within
                for k, part in enumerate((use * (p - (y == t % classes)), use * p * (1 - p))):
                    part = np.where(inside, part, 0.0)
                    sums[t][k][:, met] += np.bincount(cell, np.repeat(part, size), nodes * len(met)).reshape(nodes, -1)
                    totals[t][k] += np.bincount(node, part, nodes)
        out = []
        for t in growing:
            node, at = np.nonzero(sums[t][1])
            out.append((np.full(len(node), t), node + first, at // BINS, at % BINS, *sums[t][:, node, at]))
            there = np.flatnonzero(totals[t][1])
            out.append((np.full(len(there), t), there + first, np.full(len(there), -1), np.zeros(len(there)), *totals[t][:, there]))
        if level == 0:
            d = np.arange(len(grown))
            out.append((-1 - d, d * 0, d * 0 - 1, d * 0, loss[:, 0], loss[:, 1]))
        kinds = [pa.int32()] * 4 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).astype(t.to_pandas_dtype())) for k, t in enumerate(kinds)], ["tree", "node", "feature", "bin", "g", "h"])

    cells = rows.select(*_COLUMNS).mapInArrow(add, _CELL)
    return cells.groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


_SPLIT = "tree int, node int, feature int, cut int, gain double, g double, h double, left_g double, left_h double"


def best_cut(feature: np.ndarray, bin_: np.ndarray, g: np.ndarray, h: np.ndarray, total: tuple[float, float], zero: np.ndarray) -> tuple[int, int, float, float, float]:
    """(feature, cut, gain, left gradient, left curvature) of the best cut of a node; feature -1 if none is worth it."""
    sums = np.zeros((2, len(zero), BINS))
    sums[0, feature, bin_], sums[1, feature, bin_] = g, h
    for k in (0, 1):  # what no cell holds are the zeros
        sums[k, np.arange(len(zero)), zero] += total[k] - sums[k].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = np.array(total)[:, None, None] - left
    gain = left[0] ** 2 / (left[1] + SHRINK) + right[0] ** 2 / (right[1] + SHRINK) - total[0] ** 2 / (total[1] + SHRINK)
    gain[(left[1] < LEAST_CURVATURE) | (right[1] < LEAST_CURVATURE)] = -np.inf
    f, c = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(f), int(c), float(gain[f, c]), *left[:, f, c].tolist()) if gain[f, c] > LEAST_GAIN else (-1, 0, 0.0, 0.0, 0.0)


def _splits(cells: DataFrame, zero: np.ndarray) -> DataFrame:
    def node(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        tree, at = int(key[0]), int(key[1])
        whole = own[own["feature"] == -1]
        total = (float(whole["g"].sum()), float(whole["h"].sum()))
        inner = own[own["feature"] >= 0]
        found = (-1, 0, 0.0, 0.0, 0.0) if tree < 0 else best_cut(*(inner[c].to_numpy() for c in ("feature", "bin", "g", "h")), total, zero)
        return pd.DataFrame([(tree, at, *found[:3], *total, *found[3:])], columns=["tree", "node", "feature", "cut", "gain", "g", "h", "left_g", "left_h"])

    return cells.groupBy("tree", "node").applyInPandas(node, _SPLIT)


# ---- fitting --------------------------------------------------------------------------------------------------------------


def _leaf(g: float, h: float) -> float:
    return -RATE * g / (h + SHRINK)


def grow(vectors: DataFrame, classes: int, depths: Sequence[int], rounds: int = 40) -> tuple[list[Grown], list[np.ndarray]]:
    """Boosted trees for each depth over rows (values array<double>, y double, weight double, held boolean), or with the columns of
    `sparse` for `values`; held rows only decide when to stop. Nulls are not allowed; a class without a row keeps a score of its own like the others. Returns what was grown
    (cuts are values, not bins) and the bins' edges.
    """
    edges = bin_edges(vectors.where("NOT held"))
    zero = np.array([np.searchsorted(e, 0.0) for e in edges], np.int64)
    start = F.array_repeat(F.lit(0.0), len(depths) * classes)
    rows = checkpointed(_binned(vectors, edges, ["y", "weight", "held"]).withColumn("scores", start), "boosting")
    found = [Grown(d) for d in depths]
    since: list[list[list[Tree]]] = [[] for _ in depths]  # rounds whose scores are not in the rows yet
    for number in range(rounds + 1):
        growing = {d * classes + k: Tree.of_depth(own.depth) for d, own in enumerate(found) if own.open for k in range(classes)}
        for level in range(max(depths)):
            live = {t: tree for t, tree in growing.items() if level < found[t // classes].depth}
            if not live and level:
                break
            splits = _splits(_cells(rows, since, live, level, zero, classes), zero).collect()  # a row a node
            if level == 0:
                for s in (s for s in splits if s.tree < 0 and found[-1 - s.tree].open):
                    found[-1 - s.tree].judge(s.g / s.h if s.h else float(-len(found[-1 - s.tree].losses)))
                if number == rounds or not any(f.open for f in found):
                    return [_valued(f, edges) for f in found], edges
            for s in (s for s in splits if s.tree >= 0):
                tree = growing[s.tree]
                tree.value[s.node] = _leaf(s.g, s.h)
                if s.feature >= 0:
                    tree.feature[s.node], tree.cut[s.node] = s.feature, s.cut
                    tree.value[2 * s.node + 1] = _leaf(s.left_g, s.left_h)
                    tree.value[2 * s.node + 2] = _leaf(s.g - s.left_g, s.h - s.left_h)
        for d, own in enumerate(found):
            if own.open:
                own.rounds.append([growing[d * classes + k] for k in range(classes)])
                since[d].append(own.rounds[-1])
        if (number + 1) % KEEP == 0:
            rows, since = checkpointed(_advanced(rows, since, zero, classes), "boosting"), [[] for _ in depths]
    raise AssertionError("the last round returns")


def _advanced(rows: DataFrame, since: list[list[list[Tree]]], zero: np.ndarray, classes: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, own, _ = _asked(since, {}, len(zero))
        for batch in _slices(batches):
            scores = _scores(batch, _matrix(batch, zero, used)[0], own, classes).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(list(scores), pa.list_(pa.float64()))], _COLUMNS)

    return rows.select(*_COLUMNS).mapInArrow(add, rows.select(*_COLUMNS).schema)


def _valued(own: Grown, edges: list[np.ndarray]) -> Grown:
    """Cuts as values of the features: a value goes right if it is above."""
    for tree in (t for trees in own.rounds for t in trees):
        for node in np.flatnonzero(tree.feature >= 0):
            tree.cut[node] = edges[tree.feature[node]][int(tree.cut[node])]
    return own


# ---- model ----------------------------------------------------------------------------------------------------------------


class BoostedTreesModel(Model, HasFeaturesCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """Class probabilities of boosted trees; saved and loaded like any stage of a Spark ML pipeline."""

    trees = Param(Params._dummy(), "trees", "rounds of one tree a class, as JSON", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, trees: str = "[]", classes: int = 0, featuresCol: str = "features", probabilityCol: str = "probability"):
        super().__init__()
        self._setDefault(trees="[]", classes=0)
        self._set(**self._input_kwargs)

    @staticmethod
    def of(rounds: list[list[Tree]], classes: int) -> BoostedTreesModel:
        plain = [[[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in trees] for trees in rounds]
        return BoostedTreesModel(trees=json.dumps(plain), classes=classes)

    def _transform(self, rows: DataFrame) -> DataFrame:
        """Only the features that some tree asks for leave the JVM."""
        classes = self.getOrDefault(self.classes)
        rounds = [[Tree(np.array(f, np.int32), np.array(c), np.array(v)) for f, c, v in trees] for trees in json.loads(self.getOrDefault(self.trees))]
        used = sorted({int(f) for trees in rounds for t in trees for f in t.feature if f >= 0})
        place = {f: k for k, f in enumerate(used)}
        for tree in (t for trees in rounds for t in trees):
            tree.feature = np.array([place.get(int(f), -1) for f in tree.feature], np.int32)

        @F.pandas_udf("array<double>")
        def shares(values: pd.Series) -> pd.Series:
            matrix = np.stack(values.to_numpy()) if len(values) else np.zeros((0, len(used)))
            scores = np.zeros((len(matrix), classes))
            for trees in rounds:
                for k, tree in enumerate(trees):
                    scores[:, k] += tree.value[tree.place(matrix)]
            return pd.Series(list(softmax(scores)))

        asked = F.transform(F.array(*map(F.lit, used or [0])), lambda f: F.get("__values", f))
        return (
            rows.withColumn("__values", vector_to_array(self.getFeaturesCol()))
            .withColumn(self.getProbabilityCol(), array_to_vector(shares(asked)))
            .drop("__values")
        )
