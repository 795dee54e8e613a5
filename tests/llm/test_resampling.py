import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ticketloom.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def expected(docs, target, percent=25, least=20):
    """By the definition, one document after another: (id, n_features, weight, score, rank)."""
    place = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(place(f) for text in texts for f in features(text)) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    rows = []
    for doc, text in docs:
        found = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(place, found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 2 * least - 1), key=lambda r: (-r[3], -(1 << 63) if r[0] is None else r[0]))
    number = len(fit) * percent // 100
    return sorted(((*r, fit.index(r) + 1 if r in fit[:number] else None) for r in rows if r[0] is not None), key=str)


def texts():
    rng = np.random.default_rng(3)
    words = np.array(["Alpha", "beta", "ÉTÉ", "x9", "日本", "it's", "gamma-delta", "\x7f", "ÀB", "é"])
    return [" ".join(rng.choice(words, n)) for n in rng.integers(0, 60, 300)]


def found(spark, docs, target, **more):
    df = spark.createDataFrame([(t, k, "x", 0) for k, t in docs], "text string, doc_id long, score string, rank int").repartition(7)
    rows = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **more)
    assert rows.columns == ["id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted(((r.id, r.n_features, r.weight, r.score, r["rank"]) for r in rows.collect() if r.id is not None), key=str)


@pytest.mark.parametrize("last", [1, 5, 10_000])
def test_every_value_against_brute_force(spark, last):
    docs = [*enumerate(texts()), (900, None), (901, ""), (902, " ,;"), (903, "Word " * 30_000), (-5, "beta " * 25), (904, "beta " * 20), (905, "beta " * 19)]
    target = ["beta gamma x9 beta", None, "日本 beta"]
    assert found(spark, docs, target, last=last) == expected(docs, target)


def test_null_ids_and_repeated_rows(spark):
    docs = [(None, "a b " * 20), (None, "c"), *[(4, "a b " * 20)] * 9, (5, "b " * 30)]
    rows = found(spark, docs, ["a"], percent=50, last=1)
    assert len(rows) == 10 and {r[:4] for r in rows} == {r[:4] for r in expected(docs, ["a"])}
    df = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string"), percent=50, last=1)
    assert sorted(r["rank"] for r in df.collect() if r["rank"]) == [1, 2, 3, 4, 5]  # half of eleven, though nine are equal


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a " * 20), (2, "b " * 30)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, docs).count() == 0
    assert {r.weight for r in resampling.resample(docs, none).collect()} == {expected([(1, "a " * 20), (2, "b " * 30)], [])[0][2], expected([(1, "a " * 20), (2, "b " * 30)], [])[1][2]}
    assert [r["rank"] for r in resampling.resample(docs, none, percent=0).collect()] == [None, None]
    assert sorted(r["rank"] for r in resampling.resample(docs, none, percent=100).collect()) == [1, 2]


def test_medians():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 101):
        score, key = rng.integers(0, 4, n), rng.permutation(n)
        order = sorted(zip(score.tolist(), key.tolist()), key=lambda r: (-r[0], r[1]))
        assert resampling.middle(score, key) == order[(n - 1) // 2]
    assert resampling.weighted_median([(9, 1, 1), (5, 2, 10), (5, 1, 2), (1, 0, 3)]) == (5, 2)


def test_sql_gives_the_same_rows(spark, duck):
    duck(spark, "op11_target_resampling", queries)
