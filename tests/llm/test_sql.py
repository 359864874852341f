"""The queries that SQL can express, against DuckDB."""

import pytest

from quire.llm.queries import QUERIES, oracle_sql
from quire.plans.oracle import differences


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_rows_equal_sql(spark, name):
    assert differences(QUERIES[name], oracle_sql()[name], spark, "/root/testdata/sf0.01") == []
