import glob
import os

import duckdb
import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    """Compares a registered query with its SQL on the smallest given tables."""
    if not os.path.isdir(FOLDER):
        pytest.skip("given tables not present")
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")

    def compare(spark, name, queries):
        cursor = connection.execute(queries.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        want = sorted(map(str, cursor.fetchall()))
        df = queries.QUERIES[name](spark, FOLDER)
        assert sorted(df.columns) == sorted(columns)
        assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want

    return compare


def rows(df, *columns):
    """Rows as sorted tuples: as in the tests above this folder, which find this file first when all run at once."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)
