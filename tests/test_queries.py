"""Every registered query against its DuckDB SQL, on the smallest tables."""

import pytest

from sensemill import registry

from .conftest import SF, rows_of

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in SQL:
        r = duck.sql(SQL[name])
        names = list(r.columns)
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(names, [dict(zip(names, x)) for x in r.fetchall()])
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["o_orderkey", "o_orderpriority", "o_totalprice", "total"]
    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
