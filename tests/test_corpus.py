from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ticketloom.functions import text as x
from ticketloom.operators import corpus as c, evaluate as ev, feedback as fb, runs, training as tr


@pytest.fixture(scope="module")
def corpus(spark):
    # one class holds most rows, one group a third of them
    data = []
    for i in range(600):
        category = "big" if i % 6 else "small"
        group = "hot" if category == "big" and i % 5 < 2 else f"{category}{i % 37}"
        data.append((i, f"Text {i % 90} of {category}!", category, f"s{i % 3}", group))
    return spark.createDataFrame(data, "row_id bigint, text string, category string, source string, grp string")


def test_split_never_divides_a_group(corpus):
    split = c.grouped_split(corpus).persist()
    assert split.count() == 600 and c.split_leaks(split).count() == 0
    share = {r[0]: r[1] / 600 for r in split.groupBy("split").count().collect()}
    assert 0.6 < share["train"] < 0.9 and set(share) == {"train", "val", "test"}
    assert rows(c.grouped_split(corpus.repartition(7)), "row_id", "split") == rows(split, "row_id", "split")
    margin = c.crosstab(split, "split").filter("category = 'All' AND split = 'All'").first()["n"]
    assert margin == 600


def test_folds_are_balanced_per_label(corpus):
    sizes = c.stratified_folds(corpus, "category").groupBy("category", "fold").count().collect()
    for category in ("big", "small"):
        n = [r["count"] for r in sizes if r["category"] == category]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_first_copy_is_kept(corpus):
    kept = c.dedupe_groups(corpus, x.skeleton("text"))
    assert rows(kept, "row_id") == [(0,), (1,)]
    assert c.dedupe_text(corpus).count() == corpus.select("text").distinct().count()


def test_mix_fills_the_quota_without_repeating_texts(corpus):
    first, second = corpus.filter("row_id < 300"), corpus.filter("row_id >= 300")
    mixed = c.mix_sources(first, second, per_class=40)
    for r in mixed.groupBy("category").agg(F.count("*").alias("n"), F.sum((F.col("row_id") < 300).cast("int")).alias("a")).collect():
        assert r["a"] == 20 and r["n"] <= 40
    late = mixed.filter("row_id >= 300").select(x.dedupe_key("text").alias("k"))
    early = mixed.filter("row_id < 300").select(x.dedupe_key("text").alias("k"))
    assert late.join(early, "k").count() == 0 and late.count() == late.distinct().count()


def test_balanced_weights_sum_to_the_rows(corpus):
    total = c.balanced_weights(corpus).groupBy("category").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(300) for r in total)


def test_noise_changes_only_long_words(spark):
    df = spark.createDataFrame([(i, "Short words stay but considerable vocabulary changes sometimes.") for i in range(60)], "row_id bigint, text string")
    out = [r["text"] for r in c.augment_noise(df).collect()]
    assert all(t.startswith("short ") or t.split()[0] != "short" for t in out)
    assert len(set(out)) > 3 and all(len(t.split()) == 8 and not t.endswith(".") for t in out)
    assert all(t.split()[2] == "stay" and t.split()[3] == "but" for t in out)


def test_weight_tuning(spark):
    proba = [("low", [0.8, 0.1, 0.1])] * 5 + [("high", [0.5, 0.1, 0.4])] * 5
    df = spark.createDataFrame(proba, "y_true string, proba array<double>")
    best = ev.tune_weights(df, ["low", "medium", "high"]).first()
    assert best["weights"][0] == 1.0 and 0.4 * best["weights"][2] > 0.5 and best["macro_f1"] > 0.6


def test_weight_tuning_keeps_the_recall_floor(spark):
    proba = [("high", [0.6, 0.1, 0.3])] * 4 + [("low", [0.7, 0.1, 0.2])] * 6 + [("medium", [0.1, 0.8, 0.1])] * 4
    df = spark.createDataFrame(proba, "y_true string, proba array<double>")
    free, kept = (ev.tune_weights(df, ["low", "medium", "high"], min_last_recall=r).first() for r in (0.0, 1.0))
    assert kept["last_recall"] == 1.0 and kept["feasible"] and kept["weights"][2] >= free["weights"][2]


def test_report_of_an_absent_class_is_zero(spark):
    df = spark.createDataFrame([("v", "a", "a"), ("v", "a", "b")], "version string, y_true string, y_pred string")
    out = {r["class"]: r for r in ev.classification_report(df, ["a", "b", "c"]).collect()}
    assert (out["a"]["precision"], out["a"]["recall"], out["b"]["f1"], out["c"]["support"]) == (1.0, 0.5, 0.0, 0)
    assert ev.confusion(df, ["a", "b", "c"]).agg(F.sum("n")).first()[0] == 2


def test_feedback_export(spark):
    now = datetime(2026, 1, 1, 12)
    t = [
        (1, 1, "Help", "Parcel is late", "order_status", "low", "delivery_delay", "medium", "r1", now),
        (2, 1, "Help", "Charged twice", "order_status", "low", None, "high", "r2", now.replace(hour=13)),
        (3, 1, "Help", "Where is it", "order_status", "low", None, None, None, None),
        (4, 1, "Help", "My  mirror BROKE.", "order_status", "low", "damaged_item", None, "r1", now),
    ]
    tickets = spark.createDataFrame(t, "ticket_id bigint, tenant_id int, subject string, body string, category string, urgency string, corrected_category string, corrected_urgency string, corrected_by string, corrected_at timestamp")
    preds = spark.createDataFrame([(1, "category_classifier", v, now.replace(minute=i)) for i, v in enumerate(("v1", "v2"))], "ticket_id bigint, model_name string, model_version string, created_at timestamp")
    keys = fb.eval_keys(spark.createDataFrame([("my mirror broke.",)], "text string"))
    out = fb.feedback_export(tickets, preds, keys).collect()
    assert [r["ticket_id"] for r in out] == ["1", "2"]
    assert out[0]["text"] == "Help\nParcel is late" and out[0]["category_model_version"] == "v2"
    assert (out[1]["category"], out[1]["urgency"], out[1]["category_model_version"]) == ("", "high", "")


def test_runs(spark):
    at = lambda m: datetime(2026, 1, 1, 23, m)
    logs = [
        (1, 7, "knowledge", "{}", at(50)), (2, 7, "triage", "{}", at(51)), (3, 7, "draft", '{"error": "x"}', at(52)),
        (4, 7, "triage", "{}", at(59).replace(day=2)), (5, 7, "escalation", "{}", at(59).replace(day=3)),
    ]
    df = spark.createDataFrame(logs, "log_id bigint, ticket_id bigint, agent_name string, output string, created_at timestamp")
    out = runs.agent_runs(df)
    assert rows(out, "run_no", "logs", "finished", "failed") == [(1, 1, False, False), (2, 2, True, True), (3, 2, True, False)]
    tickets = spark.createDataFrame([(1, 7, "in_progress"), (1, 8, "new")], "tenant_id int, ticket_id bigint, status string")
    assert rows(runs.current_run(tickets, out), "ticket_id", "run_no", "logs") == [(7, 4, 0), (8, 1, 0)]


def test_training_and_batch_predictions(spark, tmp_path):
    texts = {"low": "just curious about the colour range", "high": "urgent refund now or my bank disputes it", "medium": "the parcel is late and i am worried"}
    data = [(i, f"{texts[k]} number {i}", k) for i, k in enumerate(list(texts) * 20)]
    df = spark.createDataFrame(data, "ticket_id bigint, text string, label string")
    classes = ["low", "medium", "high"]
    model, picked = tr.train_logreg(df, df, classes, cs=(2.0,), max_iter=15, places=1 << 12)
    assert picked.first()["val_macro_f1"] == 1.0
    out = {r["ticket_id"]: r for r in tr.batch_predictions(model, df, classes, "urgency_classifier", "v1").collect()}
    assert all(out[i]["prediction"] == k and out[i]["confidence"] > 0.4 for i, _, k in data)
    path = str(tmp_path / "model")
    tr.save_model(model, path)
    with pytest.raises(Exception, match="already exists"):
        tr.save_model(model, path)
    names = [r[2] for r in tr.top_coefficients(model, df, classes, 60) if r[0] == "high"]
    assert any("urgent" in n or "refund" in n for n in names)
