"""Every registered query of the engine's own operators runs; those with SQL give what it gives."""

import os

import pytest

from quillspan import catalogue
from tests.oracle import assert_same, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        assert_same(got, con, catalogue.ORACLES[name])
