"""Every registered query against DuckDB over the same tables."""

import oracle
import pytest

import __spark_entry__ as contract
from loadcast.catalog import all_queries, all_sql

QUERIES = all_queries()
SQL = all_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir).toArrow()
    if name in SQL:
        assert oracle.compare(result, duck.execute(SQL[name]).to_arrow_table()) is None
    else:
        assert result.num_rows > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 6


def test_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
