import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ticketloom.operators import boosting as b, training as tr


def data(n, seed=0):
    """Three classes; sparse features of both signs, one of them deciding with a threshold that is not zero."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, 6)) < 0.4, 0.0, np.round(rng.normal(size=(n, 6)), 1))
    y = np.where(x[:, 0] > 0.5, 2, np.where((x[:, 1] < -0.3) | (x[:, 2] > 1.0), 1, 0))
    return x, y


def rows(spark, x, y, held=None, parts=4):
    held = np.zeros(len(y), bool) if held is None else held
    table = [(r.tolist(), float(k), 1.0 + (i % 3), bool(h)) for i, (r, k, h) in enumerate(zip(x, y, held))]
    return spark.createDataFrame(table, "values array<double>, y double, weight double, held boolean").repartition(parts)


def best_by_hand(matrix, g, h):
    """Gain of the best cut over all rows, features and bins."""
    score = lambda a, c: a**2 / (c + b.SHRINK)
    best = -np.inf
    for f in range(matrix.shape[1]):
        for cut in range(b.BINS - 1):
            left = matrix[:, f] <= cut
            if min(h[left].sum(), h[~left].sum()) >= b.LEAST_CURVATURE:
                best = max(best, score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum()))
    return best


def test_first_cuts_are_the_best_over_all_rows(spark):
    x, y = data(300)
    df = rows(spark, x, y)
    (grown,), edges = b.grow(df, 3, [2], rounds=1)
    matrix = np.array([[np.searchsorted(edges[f], v) for f, v in enumerate(r)] for r in x])
    weight = 1.0 + np.arange(300) % 3
    for k, tree in enumerate(grown.rounds[0]):
        g, h = weight * (1 / 3 - (y == k)), weight * (1 / 3) * (2 / 3)
        for node, inside in [(0, np.ones(300, bool)), *((1 + side, (x[:, tree.feature[0]] > tree.cut[0]) == bool(side)) for side in (0, 1))]:
            if tree.feature[node] < 0:
                assert best_by_hand(matrix[inside], g[inside], h[inside]) <= b.LEAST_GAIN
                continue
            right = x[inside, tree.feature[node]] > tree.cut[node]
            own = sum(g[inside][s].sum() ** 2 / (h[inside][s].sum() + b.SHRINK) for s in (right, ~right)) - g[inside].sum() ** 2 / (h[inside].sum() + b.SHRINK)
            assert own == pytest.approx(best_by_hand(matrix[inside], g[inside], h[inside]))
            for side in (0, 1):
                s = right if side else ~right
                child = 2 * node + 1 + side
                if child >= 3 or tree.feature[child] < 0:
                    assert tree.value[child] == pytest.approx(-b.RATE * g[inside][s].sum() / (h[inside][s].sum() + b.SHRINK))


def test_partitions_and_written_scores_change_nothing(spark, monkeypatch):
    x, y = data(200, 1)
    plain = lambda found: [[(t.feature.tolist(), np.round(t.value, 9).tolist()) for t in trees] for trees in found[0][0].rounds]
    one = plain(b.grow(rows(spark, x, y, parts=1), 3, [3], rounds=5))
    monkeypatch.setattr(b, "KEEP", 2)
    assert plain(b.grow(rows(spark, x, y, parts=6), 3, [3], rounds=5)) == one


def test_vectors_of_either_form_grow_the_trees_of_plain_values(spark):
    x, y = data(120, 3)
    x[:40, 3:] = 0.0  # short vectors are kept sparse, others dense
    df = rows(spark, x, y, np.arange(120) % 4 == 0, parts=1)
    kept = spark.createDataFrame(
        [(Vectors.sparse(6, {int(f): float(v) for f, v in enumerate(r.values) if v}) if i % 2 else Vectors.dense(r.values), r.y, r.weight, r.held) for i, r in enumerate(df.collect())],
        ["v", "y", "weight", "held"],
    ).repartition(1)
    one, two = (b.grow(d, 3, [3], rounds=3) for d in (df, kept.select(*b.sparse(F.col("v")), "y", "weight", "held")))
    assert all(np.array_equal(e, f) for e, f in zip(one[1], two[1], strict=True))
    plain = lambda found: [[(t.feature.tolist(), np.round(t.value, 9).tolist()) for t in trees] for trees in found[0][0].rounds]
    assert plain(one) == plain(two)


def test_bins_are_the_cuts_below_a_value():
    edges = [np.array([0.0, 0.5, 2.0]), np.zeros(0), np.array([-1.0])]
    feature, value = np.repeat([0, 1, 2], 6), np.tile([-3.0, -1.0, 0.5, 0.6, 9.0, np.nan], 3)
    assert b._bins_of(feature, value, edges).tolist() == [int(np.searchsorted(edges[f], v)) for f, v in zip(feature, value)]
    assert b._bins_of(feature[:0], value[:0], []).tolist() == []


def test_learns_stops_and_survives_saving(spark, tmp_path):
    x, y = data(900, 2)
    held = np.arange(900) % 3 == 0
    grown, _ = b.grow(rows(spark, x, y, held), 3, [2, 4], rounds=40)
    assert all(g.losses[-1] < 0.5 * g.losses[0] and len(g.best()) <= len(g.rounds) <= 40 for g in grown)
    model = b.BoostedTreesModel.of(grown[1].best(), 3)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>").select("i", array_to_vector("v").alias("features"))
    PipelineModel([model]).save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    out = [sorted((r.i, tuple(r.probability)) for r in m.transform(df).collect()) for m in (model, again)]
    assert out[0] == out[1] and all(abs(sum(p) - 1) < 1e-9 for _, p in out[0])
    right = [int(np.argmax(p)) == y[i] for i, p in out[0] if held[i]]
    assert np.mean(right) > 0.95


def test_odd_tables(spark):
    x, y = np.zeros((20, 3)), np.arange(20) % 2
    (grown,), _ = b.grow(rows(spark, x, y), 3, [2], rounds=2)  # nothing to cut at, and no row of the third class
    assert all(t.feature.max() == -1 for trees in grown.rounds for t in trees)
    model = b.BoostedTreesModel.of(grown.rounds, 3)
    p = model.transform(spark.createDataFrame([([0.0] * 3,)], "v array<double>").select(array_to_vector("v").alias("features"))).first().probability
    assert p[2] < p[0] and abs(sum(p) - 1) < 1e-9
    constant = np.ones((30, 1)) * np.array([[2.0, -1.0]])
    b.grow(rows(spark, constant, np.arange(30) % 3), 3, [1], rounds=1)


def test_tickets_are_learned_into_one_pipeline(spark, tmp_path):
    texts = {"low": "just curious about the colour range", "high": "urgent refund now or my bank disputes it", "medium": "the parcel is late and i am worried"}
    df = spark.createDataFrame([(i, f"{texts[k]} number {i}", k) for i, k in enumerate(list(texts) * 20)], "ticket_id bigint, text string, label string")
    classes = ["low", "medium", "high"]
    model, picked = tr.train_trees(df, df, classes, depths=(2,), rounds=6, places=256)
    assert picked.first().val_macro_f1 == 1.0
    tr.save_model(model, f"{tmp_path}/trees")
    found = tr.batch_predictions(PipelineModel.load(f"{tmp_path}/trees"), df, classes, "urgency_classifier", "v1").join(df, "ticket_id")
    assert found.where(F.col("prediction") != F.col("label")).count() == 0


def test_folds_side_by_side_equal_single_fits(spark):
    texts = {"low": "just curious about the colour range", "high": "urgent refund now or my bank disputes it", "medium": "the parcel is late and i am worried"}
    data = [(i, f"{texts[k]} number {i % 7}", k if i % 9 else "low") for i, k in enumerate(list(texts) * 14)]
    human = spark.createDataFrame(data, "row_id bigint, text string, label string")
    weak = human.limit(20).select("text", "label")
    classes = ["low", "medium", "high"]
    side, single = (tr.cv_human_weight(weak, human, classes, weights=(0, 3), folds=3, max_iter=20, places=512, at_once=n) for n in (6, 1))
    plain = lambda df: {(r.human_weight, r.row_id): [round(p, 6) for p in r.proba] for r in df.collect()}
    assert plain(side) == plain(single) and side.count() == 2 * 42
