"""Every query with SQL equals it; every other one gives rows; all of them run on the smallest tables."""

import pytest

from tests import parity
from tidewell.plans import index as catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return parity.duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    f = catalogue.QUERIES[name]
    if name in catalogue.ORACLE_SQL:
        assert not parity.differences(spark, con, SF, f, catalogue.ORACLE_SQL[name])
    else:
        assert f(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
