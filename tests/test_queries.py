"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from quern import registry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 120


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    own = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    place = [want.columns.index(c) for c in columns]
    assert own == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
