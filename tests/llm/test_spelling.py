import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ticketloom.llm import queries, spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(docs, letters=5, occurrences=3):
    """By the definition: each run, its number, all pairs of words, the way along the forms."""
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in total.items() if len(w) >= letters and k >= occurrences}
    links = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in links.items() if x}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}
    rows = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n[w], len(links[w]), n.get(form.get(w))))
    return sorted(rows, key=str)


def found(spark, docs, **more):
    df = spark.createDataFrame([(t, k, 1, "x") for k, t in docs], "text string, doc_id long, n int, word string").repartition(5)
    return sorted((tuple(r) for r in spelling.variants(df, **more).collect()), key=str)


def texts(seed, alphabet, longest, size):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(alphabet), rng.integers(3, longest + 1))) for _ in range(size)]
    share = rng.zipf(1.5, size).astype(float)
    return [(k, " ".join(rng.choice(words, 60, p=share / share.sum()))) for k in range(200)]


@pytest.mark.parametrize("group, block", [(2048, 512), (4, 3), (1, 1)])
@pytest.mark.parametrize("alphabet, longest", [("abÀ", 7), ("abcdeéÿß", 9)])
def test_every_value_against_brute_force(spark, alphabet, longest, group, block):
    docs = texts(4, alphabet, longest, 250)
    want = expected(docs)
    assert len(want) > 50 and any(r[1] for r in want)
    assert found(spark, docs, group=group, block=block) == want


def test_forms_lead_to_the_last_word(spark):
    chain = ["commonest", "commones", "commone", "common", "commom"]
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(zip(chain, (200, 90, 40, 15, 5)))]
    rows = {r[0]: r for r in found(spark, docs)}
    assert rows == {r[0]: r for r in expected(docs)}
    assert {r[2] for r in rows.values()} == {"commonest"} and rows["commom"][1] == "common"


def test_ties_take_the_smaller_word(spark):
    docs = [(1, "zebra zebra zebra "), (2, "zebrb " * 8), (3, "zebra"[:4] + "é " + "zebré " * 7), (4, "zebrc " * 8)]
    assert found(spark, docs) == expected(docs)
    assert {r[0]: r[1] for r in found(spark, docs)}["zebra"] == "zebrb"


def test_odd_texts_and_long_runs(spark):
    long = "ab" * 3000
    docs = [(1, None), (2, ""), (3, "123 ., 日本"), (None, "words words words"), (4, f"{long} {long} {long}"), (5, f"{long}x {long}x {long}x {long}x " * 2), (6, "x" * 100_000)]
    docs += [(7, "Words WORDS words"), (7, "Words WORDS words"), (8, "ÀÀÀÀÀ àààààà ÀÀÀÀÀ ÀÀÀÀÀ")]
    assert found(spark, docs) == expected(docs)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0


def test_large_key_is_cut_until_small(spark):
    words = [f"prefix{a}{b}{c}{d}" for a in "abcdef" for b in "ghijkl" for c in "mnopqr" for d in "stuvwx"]
    docs = [(k, f"{w} {w} {w}") for k, w in enumerate(words)]
    keyed = spelling.keys(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), group=50)
    sizes = keyed.groupBy("m", "lo", "hi", "prefix", "suffix").count().collect()
    assert max(r["count"] for r in sizes if r.hi - r.lo > 1) <= 50
    assert found(spark, docs, group=50) == expected(docs)


def test_sql_gives_the_same_rows(spark, duck):
    duck(spark, "op13_spelling_variants", queries)
