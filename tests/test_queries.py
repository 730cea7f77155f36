"""Every query with an SQL twin gives the twin's rows."""

import pytest
from tests.side_by_side import compare, twin

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return twin(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, con, name):
    result = compare(spark, con, name, queries()[name], oracle_sql()[name], SF_DIR)
    assert result.startswith("ok"), result


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["grp", "n", "positive_percent"]
    assert df.count() > 0


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
