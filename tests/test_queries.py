"""Every query against its SQL on the smallest tables; those without SQL run and have rows. Queries on corpora are tested in tests/llm."""

import pytest

import __spark_entry__ as entry

from .oracle import connection, rows

CORE = {k: v for m in entry.MODULES for k, v in __import__(m, fromlist=["QUERIES"]).QUERIES.items()}


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, data, con, name):
    got = CORE[name](spark, data).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.num_columns
        return
    want = con.sql(sql).to_arrow_table()
    names, mine = rows(got)
    their_names, theirs = rows(want)
    assert names == their_names
    assert mine == theirs


def test_entry_has_rows_and_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "name", "sector", "date", "momentum_20d", "sma_20d", "volatility_20d"]
    assert df.count() > 0
