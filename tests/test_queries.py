"""Every registered query of the library against its SQL on the smallest tables."""

import os

import pytest

from eventloom.plans import registry
from tests.compare import connection, same

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Queries that SQL cannot say: tests/test_signals_sources.py and tests/test_rules.py hold them against plain Python.
ROWS_ONLY = {"a11_effect_p", "a13_contamination_p", "d1_envelope", "d2_d3_filtered", "d3_resampled", "d8_rhythm_mask", "d8_suppressed"}


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


def test_only_signal_helpers_lack_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    if name in registry.ORACLES:
        same(df, con, registry.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
