"""Every query outside the optional subpackage against its SQL at the smallest scale."""

import os

import pytest

from kernmill.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE:
        assert oracle.compare(df, con, catalog.ORACLE[name]) == ""
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
