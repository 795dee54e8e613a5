import re

import numpy as np

from ticketloom.llm import hashing, quality


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(a in lines[:i] for i, a in enumerate(lines)), len(covered), failed


TEXTS = [
    None, "", " \n\t", "one", "a b c d e a b c d e", "a " * 30, "x y z\nx y z\n\n \n \nx y z ", "é|<> ##   \x1c\x85 **",
    "a b c d e f g a b c d e h", "\n".join(["line of five words here"] * 3 + ["other"]), "w" * 5000,
]


def test_counts_equal_brute_force():
    rng = np.random.default_rng(0)
    texts = TEXTS + [" ".join(f"w{i}" for i in rng.integers(0, 4, 80)) for _ in range(30)]
    for text in texts:
        assert quality.counts(text) == brute(text), text


def test_words_are_hashed_by_content():
    codes, starts = hashing.code_points(["ab cd", "cd\tab x y", "", "ab"])
    at, h = hashing.words(codes)
    assert len(at) == 6 and h[0] == h[3] == h[5] and h[1] == h[2] and len(set(h.tolist())) == 3


def labelled(spark, n=400):
    rng = np.random.default_rng(1)
    vocabulary = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = [vocabulary[k] for k in rng.integers(0, 200, 60)]
        good = i % 4 != 0
        rows.append((i, " ".join(words) if good else "!!! ".join(w.upper() for w in words), int(good)))
    return spark.createDataFrame(rows, "id long, text string, class int")


def test_verdict_on_unseen_rows(spark):
    rows = labelled(spark)
    model = quality.fit(rows.select("id", "text"), rows.where("id < 300").select("id", "class"))
    got = {r.id: r for r in quality.judge(rows, model, "id").collect()}
    assert all(got[i].kept == (i % 4 != 0) for i in range(300, 400))
    assert all(0 <= r.quality <= 1 for r in got.values())


def test_odd_rows(spark):
    rows = labelled(spark, 80)
    model = quality.fit(rows, rows.select("id", "class"))
    docs = spark.createDataFrame([(k, t, True) for k, t in enumerate(TEXTS)] + [(None, "a b", True), (3, "one", True)], "doc_id long, text string, kept boolean")
    got = quality.judge(docs, model).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(TEXTS[r.id])
    nothing = quality.fit(docs.selectExpr("doc_id AS id", "text").limit(0), rows.select("id", "class").limit(0))
    assert quality.judge(docs.limit(0), nothing).count() == 0
    assert all(r.kept != r.base_failed for r in quality.judge(docs, nothing).collect())
