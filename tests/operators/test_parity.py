"""Every registered query that has SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import pytest

from orefield.plans import registry

registry.load()


def rows(table):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 4) if isinstance(x, float) or type(x).__name__ == "Decimal" else x

    return sorted((tuple(plain(r[c]) for c in sorted(r)) for r in table), key=str)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(tiny):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{tiny}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_parity(spark, tiny, duck, name):
    df = registry.QUERIES[name](spark, tiny)
    want = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(r.asDict() for r in df.collect())
    assert got, "nothing is compared with nothing"
    assert got == rows(dict(zip(want.columns, r, strict=True)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_queries_without_sql_have_rows(spark, tiny, name):
    assert registry.QUERIES[name](spark, tiny).count() > 0
