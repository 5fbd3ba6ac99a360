"""Every registered query of this subpackage runs over whole tables; those with SQL give what it gives."""

import os

import pytest

from quillspan.llm import queries
from tests.oracle import assert_same, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, con, name):
    frame = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        assert_same(frame.toPandas(), con, queries.ORACLES[name])
    elif name.startswith("op"):
        table = "conversations" if name.startswith("op2") else "documents"
        assert frame.count() == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
