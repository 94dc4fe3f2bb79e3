"""Every registered query against its DuckDB twin (the driver's correctness gate), at sf0.001.

Run ``python tests/compare.py /root/testdata/sf0.01`` for the driver's scale.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from newsprism import catalog
from tests.compare import compare, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "category" in df.columns


def test_every_query_has_sql():
    missing = sorted(set(catalog.QUERIES) - set(SQL))
    assert missing == []
    assert set(catalog.QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    table = queries()[name](spark, SF).toArrow()
    want = con.sql(SQL[name]).to_arrow_table()
    types = {f.name: str(f.type) for f in table.schema}
    assert types == {f.name: str(f.type) for f in want.schema}
    ok, msg = compare(table.to_pandas(), want.to_pandas())
    assert ok, msg
