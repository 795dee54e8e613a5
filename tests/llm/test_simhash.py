import re

import numpy as np
import xxhash

from ticketloom.llm import simhash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    """Smallest id of each row's component, by comparing all pairs."""
    ids = [i for i, _ in marks]
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(marks):
        for j, b in marks[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_golay_corrects_three_errors():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    index = simhash.nearest(words)
    assert len(np.unique(simhash._ERRORS)) == 2048
    for _ in range(3):
        errors = np.bitwise_or.reduce(1 << np.array([rng.permutation(23)[:3] for _ in words]), axis=1)
        codewords = words ^ simhash._ERRORS[simhash._syndromes(words)]
        assert (simhash.nearest(codewords ^ errors) == index).all()


def test_keys_are_shared_up_to_distance_three():
    rng = np.random.default_rng(2)
    marks = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for flips in (1, 2, 3):
        other = marks.copy()
        for k in range(len(other)):
            for bit in rng.permutation(64)[:flips]:
                other[k] ^= np.uint64(1 << int(bit))
        sets = []
        for side in (marks, other):
            of = [set() for _ in side]
            for row, key in simhash.keys(side):
                for r, x in zip(row.tolist(), key.tolist()):
                    of[r].add(x)
            sets.append(of)
        assert all(a & b for a, b in zip(*sets))


def test_fingerprints_equal_brute_force():
    for text in [None, "", " \n", "One", "one two", "A b C d", "the cat " * 400, "Ünï ÇA É b c d", "x" * 100_000 + " y z w"]:
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


def test_components_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", "  ", "one", "one two"]
    for _ in range(25):
        base = [words[i] for i in rng.integers(0, 60, 60)]
        texts.append(" ".join(base))
        for _ in range(4):
            changed = list(base)
            changed[rng.integers(0, 60)] = "changed"
            texts.append(" ".join(changed))
        texts.append(" ".join(base).upper())
    marks = [(i, brute_fingerprint(t)) for i, t in enumerate(texts)]
    expected = brute_components(marks)
    docs = spark.createDataFrame([(i, t, "fp") for i, t in enumerate(texts)], "doc_id long, text string, component string").repartition(3)
    got = {r.id: (r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fp, expected[i]) for i, fp in marks}
    assert len(set(expected.values())) < len(texts) - 30


def test_crowded_keys_are_dealt_out_again(spark):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 62))
    marks = {centre}
    while len(marks) < 300:
        marks.add(centre ^ sum(1 << int(b) for b in rng.permutation(62)[: rng.integers(1, 5)]))
    marks = sorted(marks)
    few = simhash.KEY_ROWS
    try:
        simhash.KEY_ROWS = 10
        batch = _run(simhash._links(False), marks)
        assert any(k is not None for _, _, k in batch)
        again = sorted((k, a) for a, _, k in batch if k is not None)
        edges = [(a, b) for a, b, k in batch if k is None]
        edges += [(a, b) for a, b, _ in _run(simhash._links(True), [a for _, a in again], [k for k, _ in again])]
    finally:
        simhash.KEY_ROWS = few
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    assert _groups(marks, edges) == _groups(marks, [(a, b) for a in marks for b in marks if (a ^ b).bit_count() <= 3])


def _run(links, marks, keys=None):
    import pyarrow as pa

    keys = keys or [5] * len(marks)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(keys[i : i + 64], pa.int64()), pa.array(marks[i : i + 64], pa.int64())], ["key", "fp"])
        for i in range(0, len(marks), 64)
    ]
    return [tuple(r.values()) for out in links(iter(batches)) for r in out.to_pylist()]


def _groups(nodes, edges):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    rows = [(7, "same text of five words here"), (7, "same text of five words here"), (None, "same text of five words here"), (3, None)]
    got = sorted((str(r.id), r.component) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("3", 3), ("7", 7), ("7", 7), ("None", 7)]
