import os

import pytest

from kernmill.llm import queries
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE:
        assert oracle.compare(df, oracle.duck(SF), queries.ORACLE[name]) == ""
    else:
        assert df.count() > 0
