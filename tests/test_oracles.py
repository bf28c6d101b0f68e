"""Every registered query against its SQL oracle, over the whole tables at sf0.001."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).df()
        problem = compare(got, want)
        assert problem is None or problem.startswith("TYPES"), problem
    else:
        assert len(got.columns) > 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
