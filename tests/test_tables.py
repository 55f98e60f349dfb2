"""Every registered query that has SQL against it, on the smallest tables."""

import pytest

from __spark_entry__ import LLM_QUERIES, entry, oracle_sql, queries
from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
NAMES = [name for name in queries() if name not in LLM_QUERIES]


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert NAMES and set(NAMES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    problem, _, _ = differences(spark, db, SF_DIR, name, queries()[name], oracle_sql()[name])
    assert problem is None, problem


def test_entry(spark):
    assert entry(spark).count() > 0
