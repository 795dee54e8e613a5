"""Every registered query with a SQL twin, compared on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

from ticketloom.plans.registry import all_oracles, all_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if value is None or value != value:
        return "null"
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


def _table(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    expected = _table([c[0] for c in cursor.description], cursor.fetchall())
    assert _table(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["page_text", "chunk_sections", "mask_contact", "kb_search_ann", "embed_texts", "augment_noise", "grounded_prompt_rows", "ticket_triage"])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
