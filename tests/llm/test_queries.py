import pytest

from siltstone.llm import queries as llm
from tools.compare import differences


@pytest.fixture(scope="session")
def llm_outcomes(spark, small):
    return differences(spark, small, llm.queries(), llm.oracle_sql())


@pytest.mark.parametrize("name", llm.queries())
def test_query_equals_its_sql(llm_outcomes, name):
    assert llm_outcomes[name] is None, llm_outcomes[name]
