"""Every registered query: equal to its SQL, and planned without what does not scale."""

import pytest
from check_oracle import compare, oracle

import __spark_entry__ as entry
from cinderlog.catalog.registry import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, con, sf_dir, name):
    verdict, _, _, _ = compare(spark, con, QUERIES[name], sf_dir)
    assert verdict == "ok"


def test_contract():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(query) for query in entry.queries().values())


def test_entry(spark):
    assert entry.entry(spark).columns == ["start", "group", "count"]
