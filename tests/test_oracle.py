"""Every registered query of the library against its SQL, and those without SQL for rows and a stable schema."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry._own()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        assert compare(got, con.sql(ORACLE[name]).df()) == ""
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names():
    assert set(ORACLE) <= set(QUERIES)
