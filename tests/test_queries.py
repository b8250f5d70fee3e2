"""Every registered query against its SQL form, on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registered
from tools.compare import table

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, con, name):
    frame = registered.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in frame.collect()]
    assert rows
    if name in registered.oracle_sql():
        result = con.execute(registered.oracle_sql()[name])
        expected = table([d[0] for d in result.description], result.fetchall())
        assert table(frame.columns, rows) == expected
        described = con.execute("DESCRIBE " + registered.oracle_sql()[name]).fetchall()
        assert dict(frame.dtypes) == {r[0]: TYPES.get(r[1], r[1]) for r in described}


def test_entry(spark):
    summary = registered.entry(spark)
    assert summary.columns == ["split", "shard", "n_docs", "n_tokens", "n_blocks", "n_batches"]
    assert summary.count() == 20
