"""Every registered graph query against its SQL."""

import os

import oracle
import pytest

from lodestone.plans import catalog, checks, reports, walks  # noqa: F401  the others add their queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.QUERIES.items() if sql])
def test_query(spark, con, name):
    query, sql = catalog.QUERIES[name]
    assert oracle.compare(query(spark, SF), con, sql) == ""
