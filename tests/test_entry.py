import pytest

import __spark_entry__ as entry
from siltstone.plans import catalog, lexical_queries
from tools.compare import differences


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["query", "doc", "score", "rank"]


def test_sql_has_a_query_each():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="session")
def outcomes(spark, small):
    for tokenizer in ("bow", "standard"):
        lexical_queries.index(spark, small, tokenizer)
    return differences(spark, small, catalog.queries(), catalog.oracle_sql())


@pytest.mark.parametrize("name", catalog.queries())
def test_query_equals_its_sql(outcomes, name):
    assert outcomes[name] is None, outcomes[name]
