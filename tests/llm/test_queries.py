import pytest

import oracle
from convomill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert oracle.differences(queries.queries()[name](spark, SF), oracle.database(SF), queries.oracle_sql()[name]) == ""
