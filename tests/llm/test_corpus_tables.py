"""The corpus queries that have SQL against it, on the smallest tables."""

import pytest

from compare import connect, differences
from siftlog.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_corpus_query_equals_sql(spark, name):
    problem, _, _ = differences(spark, connect(SF_DIR), SF_DIR, name, QUERIES[name], ORACLE[name])
    assert problem is None, problem
