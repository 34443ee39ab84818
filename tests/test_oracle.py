"""Every registered query against its SQL counterpart; the rest must at least run."""

import pytest
from oracle import compare, connect, duck_rows, spark_rows

from tidewatch.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    assert compare(spark_rows(QUERIES[name](spark, sf)), duck_rows(duck, ORACLES[name])) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
