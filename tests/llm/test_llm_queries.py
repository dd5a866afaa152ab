"""Registered queries against their SQL."""

import pytest

from quire.llm.queries import QUERIES
from quire.llm.sql import SQL
from tests.compare import oracle_rows, spark_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    names, rows = spark_rows(QUERIES[name](spark, sf))
    want_names, want = oracle_rows(sf, SQL[name])
    assert names == want_names
    assert rows == want, (list((rows - want).items())[:3], list((want - rows).items())[:3])
