"""Every registered query next to its SQL twin, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
TWINS = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name in TWINS:
        assert differences(df, con, TWINS[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() == 200
