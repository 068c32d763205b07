"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os
from datetime import date, datetime

import duckdb
import pytest

from newsloom.registry import registered

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registered()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        path = f"{SF}/{t}/*.parquet" if os.path.isdir(f"{SF}/{t}") else f"{SF}/{t}"
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return int(v) if v == v and abs(v) < 1e15 and v == int(v) else round(v, 7)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v) if isinstance(v, date | datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    if q.sql is None:
        assert got
        return
    rel = duck.sql(q.sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())
