"""Every registered query against its DuckDB SQL on the same tables."""

import math

import duckdb
import pytest

from waymark.catalog import ORACLE_SQL, QUERIES
from waymark.plans.views import TABLES


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert df.columns
    if name not in ORACLE_SQL:
        return
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted(rel.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=repr)
    assert len(got) == len(want)
    assert got, "the query has no rows on the test tables"
    for g, w in zip(got, want, strict=True):
        assert all(same(a, b) for a, b in zip(g, w, strict=True)), (g, w)
