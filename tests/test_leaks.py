import numpy as np
import pytest

from ticketloom.operators import leaks


def expected(texts, items, least):
    """All pairs, word by word."""
    split = lambda t: " ".join((t or "").split()).lower().split(" ")
    grams = lambda w: [tuple(w[k : k + least]) for k in range(len(w) - least + 1)]
    out = []
    for key, text in texts:
        windows = grams(split(text))
        for item, item_text in items:
            own = set(grams(split(item_text)))
            at = [k for k, g in enumerate(windows) if g in own]
            spans, first = [], None
            for k in at:
                if first is None or k != before + 1:  # noqa: F821
                    spans.append([k, least])
                    first = k
                else:
                    spans[-1][1] += 1
                before = k
            if at:
                shared = len({windows[k] for k in at})
                out.append((key, item, ",".join(f"{a}:{n}" for a, n in spans), shared, len(own), round(shared / len(own), 9)))
    return sorted(out)


def found(spark, texts, items, **more):
    a = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "row_id long, text string, words string, start int").repartition(5)
    b = spark.createDataFrame([(k, t, "y") for k, t in items], "item_id string, text string, hash string")
    return sorted((*tuple(r)[:5], round(r.share, 9)) for r in leaks.passages(a, b, **more).collect())


def sample(seed, size=120, words=14, longest=60):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{k}" for k in range(words)])
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=[0.5, *[0.5 / (words - 1)] * (words - 1)]))
    items = [(f"i{k}", draw(rng.integers(0, 25))) for k in range(12)]
    texts = []
    for k in range(size):
        parts = [draw(rng.integers(0, longest))]
        for _ in range(rng.integers(0, 3)):
            own = items[rng.integers(len(items))][1].split()
            a = rng.integers(0, len(own) + 1)
            parts += [" ".join(own[a : a + rng.integers(0, 25)]), draw(rng.integers(0, 9))]
        texts.append((k, "\n ".join(parts).upper() if k % 3 else "  ".join(parts)))
    return texts, items


@pytest.mark.parametrize("least, shingle", [(8, 5), (5, 5), (4, 2)])
def test_passages_against_all_pairs(spark, least, shingle):
    texts, items = sample(least)
    want = expected(texts, items, least)
    assert len(want) > 40
    assert found(spark, texts, items, least=least, shingle=shingle) == want


def test_common_boilerplate_is_joined_by_its_rare_runs_only(spark):
    """A phrase that every text and every item has forms no pair unless a whole window is shared."""
    phrase = "we thank you for your order"
    items = [(f"i{k}", f"{phrase} about thing{k} and what came after it on day{k} of the week") for k in range(30)]
    texts = [(k, f"hello {phrase} of number {k} which was sent") for k in range(300)] + [(1000, items[7][1])]
    assert found(spark, texts, items) == expected(texts, items, 8)
    assert len(expected(texts, items, 8)) == 1


def test_odd_texts(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    items = [("a", passage), ("a", passage), ("b", None), ("c", ""), ("d", "too short"), (None, "q " * 30)]
    texts = [(1, None), (2, ""), (3, passage), (3, passage), (4, "x " * 50_000 + passage + " y" * 50_000), (None, passage), (5, "q " * 9), (6, passage.upper().replace(" ", "\t\n"))]
    rows = leaks.passages(spark.createDataFrame(texts, "row_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    got = sorted((r.row_id or 0, r.item_id or "", r.spans, r.share) for r in rows)
    once = [(0, "0:20"), (3, "0:20"), (3, "0:20"), (4, "50000:20"), (6, "0:20")]
    assert got == sorted([(k, "a", s, 1.0) for k, s in once for _ in range(2)] + [(5, "", "0:9", 1.0)])
    none = spark.createDataFrame([], "row_id long, text string")
    assert leaks.passages(none, spark.createDataFrame(items, "item_id string, text string")).count() == 0
    assert leaks.passages(spark.createDataFrame(texts, "row_id long, text string"), spark.createDataFrame([], "item_id string, text string")).count() == 0
    with pytest.raises(ValueError):
        leaks.passages(none, none, least=4, shingle=5)


def test_rows_without_passages_stay(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    texts = spark.createDataFrame([(1, passage), (2, "a " + passage[:60]), (3, None), (None, "z"), (4, f"x {passage} y")], "row_id long, text string")
    items = spark.createDataFrame([("a", passage)], "item_id string, text string")
    assert sorted(r.row_id or 0 for r in leaks.without_passages(texts, items).collect()) == [0, 2, 3]
