import numpy as np
from pyspark.sql import functions as F

from ticketloom.llm import toxicity as t
from ticketloom.llm.common import fold

BAD = ["idiotic", "worthless", "scumbag", "moronic"]


def brute_kernel(a, b):
    """Sum over shared subsequences of three letters with at most MOST_GAPS gaps, by the same norm."""

    def spots(word):
        rows, _ = t.encode([word])
        row = rows[0][rows[0] > 0].tolist()
        return [
            ((row[i], row[j], row[k]), t.GAP ** (k - i - 2))
            for i in range(len(row)) for j in range(i + 1, len(row)) for k in range(j + 1, len(row)) if k - i - 2 <= t.MOST_GAPS
        ]

    x, y = spots(a), spots(b)
    norm = np.sqrt(sum(w * w for _, w in x) * sum(w * w for _, w in y))
    return sum(u * v for s, u in x for r, v in y if s == r) / norm


def test_kernel_equals_brute_force_and_folds():
    words = ["idiot", "idxiot", "idot", "clown", "abab", "é"]
    rows, owner = t.encode(words)
    assert owner.tolist() == list(range(len(words)))
    got = t.kernel(rows, rows)
    assert np.allclose(got, [[brute_kernel(a, b) for b in words] for a in words], atol=1e-5)
    assert got[0, 1] > 0.3 > got[0, 3]
    share = np.array([1.0, -0.5, 0.2, 0.0, 0.3, 1.0])
    assert np.allclose(t.margins(words, t.fold_weights(rows, share), 0.25), got @ share + 0.25, atol=1e-4)


def test_units_join_spelled_words():
    assert "idiot" in t.units("you I d i o t now") and t.units(None) == set() and t.units(" a b ") == {"a", "b"}
    rows, owner = t.encode(["x" * 100])
    assert len(rows) > 4 and set(owner) == {0}


def corpus(spark, n=420):
    rng = np.random.default_rng(8)
    clean = [f"{a}{b}{c}" for a in ("ban", "tor", "lim", "pes") for b in ("ado", "iru", "ele") for c in ("m", "st", "ra", "")]
    rows = []
    for i in range(n):
        words = [clean[k] for k in rng.integers(0, len(clean), 30)]
        if i % 5 == 0:
            for bad in rng.choice(BAD, 2):
                words[rng.integers(0, 30)] = bad
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "id long, text string, class int")


def test_held_out_texts_and_disguises(spark):
    rows = corpus(spark)
    model = t.fit(rows.select("id", "text"), rows.where(fold("id", 3) != 1).select("id", "class"))
    got = t.toxicity(rows, model, "id").join(rows, "id").where(fold("id", 3) == 1).collect()
    right = [(r.score >= 0.7) == (r["class"] == 1) for r in got]
    assert np.mean(right) > 0.97
    plain, disguised, clean = model.margin(["banado idiotic limiru", "banado id-io-tic limiru, w o r t h l e s s", "banado limiru torelest"])
    assert min(plain, disguised) > clean + 0.5
    inserted = t.margins(["worthxless", "banadora"], model.table, model.bias)
    assert inserted[0] > inserted[1]


def test_few_toxic_texts_reach_the_threshold(spark):
    """The calibration sees each of the few toxic texts once, so sure ones score above it."""
    rows = corpus(spark, 150)
    model = t.fit(rows.select("id", "text"), rows.where(fold("id", 3) != 1).select("id", "class"))
    got = t.toxicity(rows, model, "id").join(rows, "id").where(fold("id", 3) == 1).collect()
    toxic = [r.score >= 0.7 for r in got if r["class"] == 1]
    assert np.mean(toxic) > 0.8 and not any(r.score >= 0.7 for r in got if r["class"] == 0)


def test_a_common_word_is_no_witness(spark):
    """Toxic texts without an insult that the machine knows do not make a word of most texts toxic."""
    rows = corpus(spark, 300).withColumn("text", F.concat("text", F.lit(" the")))
    extra = spark.range(1000, 1006).select("id", F.lit("the the").alias("text"), F.lit(1).alias("class"))
    model = t.fit(rows.unionByName(extra).select("id", "text"), rows.unionByName(extra).select("id", "class"))
    assert t.margins(["the"], model.table, model.bias)[0] < 0 < t.margins([BAD[0]], model.table, model.bias)[0]


def test_odd_rows(spark):
    rows = corpus(spark, 120)
    model = t.fit(rows, rows.select("id", "class"))
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, " \n", 1), (None, "idiotic", 1), (4, "idiotic " * 20_000, 1), (4, "z" * 90_000, 1), (5, "!!! 123", 1)],
        "doc_id long, text string, score int",
    )
    got = t.toxicity(docs, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.id in (1, 2, 3)} == {next(r.score for r in got if r.id == 2)}
    assert t.toxicity(docs.limit(0), model).count() == 0
    untaught = t.fit(rows.select("id", "text"), rows.where("class = 0").select("id", "class"))
    assert {r.score for r in t.toxicity(docs, untaught).collect()} == {0.0}
