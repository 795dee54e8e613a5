import numpy as np
import pytest

from ticketloom.operators import ann, retrieval as rt
from conftest import rows


def table(spark, vectors, key, tenants=1):
    data = [(k, k % tenants, v if v is None else [float(x) for x in v], "x") for k, v in enumerate(vectors)]
    return spark.createDataFrame(data, f"{key} bigint, tenant_id int, embedding array<float>, cell string")


def clusters(seed, n, dim=16, centres=12):
    """Points around a few centres; the centres do not depend on the seed."""
    middle = np.random.default_rng(0).normal(size=(centres, dim))
    rng = np.random.default_rng(seed)
    return middle[rng.integers(0, centres, n)] + rng.normal(scale=0.25, size=(n, dim))


def test_recall_and_work_saved(spark, tmp_path):
    e, q = table(spark, clusters(1, 3000), "entry_id", 2), table(spark, clusters(2, 120), "query_id", 2)
    hits, figures = ann.search_measured(e, q, f"{tmp_path}/index", 5)
    exact = set(rows(rt.search_topk(q, e, 5), "query_id", "entry_id"))
    assert figures["recall"] >= 0.9 and len(exact & set(rows(hits, "query_id", "entry_id"))) >= 0.9 * len(exact)
    assert figures["exact_compared"] == 120 * 1500 and figures["compared"] < figures["exact_compared"] / 3
    assert figures["cells"] == round(3000**0.5)


def test_saved_index_serves_later_searches(spark, tmp_path):
    vectors = clusters(3, 400)
    e = table(spark, vectors, "entry_id")
    ann.build(e, f"{tmp_path}/index", cells=8)
    again = ann.load(spark, f"{tmp_path}/index")
    assert again.codes.count() == 400 and again.sizes.agg({"n": "sum"}).first()[0] == 400
    q = table(spark, clusters(4, 30), "query_id")
    every = rows(ann.search(again, q, e, probes=8, k=3), "query_id", "entry_id", "rank")
    assert every == rows(rt.search_topk(q, e, 3), "query_id", "entry_id", "rank")  # all cells: the exact answer
    one = ann.probed(again, q, 1).collect()
    distance = ((again.centres[None] - np.array([np.array(r.embedding) / np.linalg.norm(r.embedding) for r in one])[:, None]) ** 2).sum(-1)
    assert [r.cell for r in one] == distance.argmin(1).tolist()
    listed = ann.compared(again, q, 1)
    assert listed[1] == 30 * 400 and 0 < listed[0] < listed[1]


@pytest.mark.parametrize("size", [7, 300])
def test_small_grid_cells_change_nothing(spark, tmp_path, size):
    e, q = table(spark, clusters(5, 200), "entry_id", 3), table(spark, clusters(6, 40), "query_id", 4)
    index = ann.build(e, f"{tmp_path}/index", cells=6)
    found = rows(ann.search(index, q, e, probes=6, k=4, rows=size), "query_id", "entry_id", "rank")
    assert found == rows(rt.search_topk(q, e, 4), "query_id", "entry_id", "rank")


def test_missing_vectors_copies_and_empty_tables(spark, tmp_path):
    same = np.ones(4)
    e = table(spark, [same] * 60 + [None, [], np.zeros(4), -same], "entry_id")
    q = table(spark, [same, None, [], np.zeros(4)], "query_id")
    hits, figures = ann.search_measured(e, q, f"{tmp_path}/a", 3)
    top = [r for r in rows(hits, "query_id", "entry_id", "rank") if r[0] == 0]
    assert top == [(0, 0, 1), (0, 1, 2), (0, 2, 3)] and figures["recall"] >= 0.9  # of equal vectors the smallest ids
    assert {r[0] for r in rows(hits, "query_id")} <= {0, 3}
    hits, figures = ann.search_measured(e.limit(0), q, f"{tmp_path}/b", 3)
    assert hits.count() == 0 and figures["compared"] == 0
    assert ann.search_measured(e, q.limit(0), f"{tmp_path}/c", 3)[0].count() == 0
