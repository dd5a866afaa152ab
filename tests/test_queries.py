"""Every registered query with SQL against DuckDB on the smallest tables; the others have rows."""

import pytest

import __spark_entry__ as e
from tests.compare import oracle_rows, spark_rows
from quire.oracles import SQL
from quire.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        names, rows = spark_rows(df)
        want_names, want = oracle_rows(SF, SQL[name])
        assert names == want_names
        assert rows == want, (list((rows - want).items())[:3], list((want - rows).items())[:3])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
