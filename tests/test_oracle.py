"""Every registered query with SQL gives the rows of that SQL."""

import pytest

import __spark_entry__ as contract
from tarnwork.workload import SQL, full_sql
from tests import oracle

SQLS = {name: full_sql(name) for name in SQL}


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_sql(spark, sf, con, name):
    df = contract.queries()[name](spark, sf)
    problem = oracle.difference(oracle.spark_rows(df), oracle.sql_rows(con, SQLS[name]))
    assert problem is None, problem


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["order_date", "region", "order_count", "total_amount"]
    assert df.count() > 0
