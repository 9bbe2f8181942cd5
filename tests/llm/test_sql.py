import pytest
from oracle import differences

from docweave.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE_SQL[name]) == []
