import os

import pytest
from oracle import differences

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = {k: v for k, v in entry.plans.ORACLE_SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, SF, entry.plans.QUERIES[name], SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(entry.plans.QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
