import hashlib
import re

import pytest

from ticketloom.llm import exact_dedup


def brute(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    out = []
    for i, t in rows:
        group = [(-len(u or ""), j is None, j or 0, j) for j, u in rows if norm(u) == norm(t)]
        out.append((str(i), str(min(group)[3]), len(group), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


ROWS = [(5, "a b"), (2, "a  b"), (9, "ab"), (1, None), (3, ""), (4, " \n"), (7, "é x"), (7, "é x"), (None, "ab "), (None, None), (8, "y" * 90_000), (6, "a\xa0b")]


@pytest.mark.parametrize("copies", [0, 60])
def test_groups_equal_brute_force(spark, copies):
    rows = ROWS + [(100 + k, "hot text" + " " * (k % 3)) for k in range(copies)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keep_id string").repartition(4)
    got = exact_dedup.mark_copies(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_table(spark):
    assert exact_dedup.mark_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
