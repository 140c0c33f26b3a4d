"""Every query next to its checking SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare, connect

from .conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, msg = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert ok, msg


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns
