import os

import pytest

from eventloom.llm import queries
from tests.compare import connection, same

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    if name in queries.ORACLES:
        assert same(df, connection(DATA), queries.ORACLES[name])
    else:
        assert df.count()

