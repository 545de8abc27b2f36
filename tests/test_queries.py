"""Every registered query against its SQL, over whole tables."""

import pytest

import oracle
from catalogloom.driver.registry import ALL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_matches_sql(spark, con, name):
    problems, rows = oracle.compare(spark, con, ALL[name], SF)
    assert not problems, problems
    assert rows > 0


def test_every_query_has_sql():
    assert [n for n, q in ALL.items() if q.sql is None] == []
