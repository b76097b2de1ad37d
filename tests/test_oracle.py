"""Every registered query against its SQL on the smallest tables."""

import pytest

from shardloom.plans import catalog
from tests.compare import check, oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert check(spark, con, SF_DIR, QUERIES[name], SQL.get(name)) is None


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(SQL)
