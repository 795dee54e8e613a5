import numpy as np

from ticketloom.llm import hashing, language, linear
from ticketloom.llm.common import fold

EN = "the quick brown fox jumps over the lazy dog and then it runs through the forest with other animals while rain falls"
DE = "der schnelle braune fuchs springt über den faulen hund und dann läuft er durch den wald mit anderen tieren bei regen"


def mixed(words, k):
    rng = np.random.default_rng(k)
    return " ".join(rng.permutation(words.split())[:12])


def corpus(spark, copies=60):
    rows = [(2 * k, mixed(EN, k), "en") for k in range(copies)] + [(2 * k + 1, mixed(DE, k), "de") for k in range(copies)]
    return spark.createDataFrame(rows, "id long, text string, lang string")


def test_held_out_accuracy_and_calibration(spark):
    docs = corpus(spark)
    model = language.fit(docs.where(fold("id", 4) != 2))
    rows = language.identify(docs, model, "id").join(docs.select("id", "lang"), "id").where(fold("id", 4) == 2).collect()
    assert len(rows) > 15
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark):
    model = language.fit(corpus(spark))
    texts = [None, "", "  \n", "1234 !!", "\U0001f600", "the rain", "der hund und der wald " * 20_000, "the rain"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    got = {r.id: r for r in language.identify(docs, model).collect()}
    assert [got[k].lang_pred for k in range(5)] == ["und"] * 5 and all(got[k].score == 0 for k in range(5))
    assert got[6].lang_pred == "de" and got[5].lang_pred == "en"
    assert got[5].score == got[7].score


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "id long, text string, lang string")
    assert language.identify(empty, language.fit(empty), "id").count() == 0
    only_null = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(only_null, language.fit(only_null), "id").collect()} == {"und"}


def test_penalty_makes_weights_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 2, 2 + rng.integers(0, 500)]), np.array([1.0, 0.05])) for k in range(400)]
    labels = np.array([k % 2 for k in range(400)])
    dense = linear.ftrl(rows, labels, 600, 2, 0.5, 1.0, 0.0, 0.0, 2)
    sparse = linear.ftrl(rows, labels, 600, 2, 0.5, 1.0, 0.5, 0.01, 2)
    assert np.count_nonzero(sparse) < np.count_nonzero(dense) / 4
    assert sparse[0, 0] > 0 > sparse[1, 0]


def test_a_batch_does_not_change_a_text():
    texts = ["Ünï code", "", "word word other", None, "a"]
    table = np.random.default_rng(1).normal(size=(hashing.BUCKETS + 1, 3))
    together, _ = language.logits(texts, table, np.zeros(3))
    for k, text in enumerate(texts):
        assert np.allclose(language.logits([text], table, np.zeros(3))[0][0], together[k])
