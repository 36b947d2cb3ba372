"""Queries with SQL give DuckDB's rows on small tables, and stay as wide as their operators."""

import duckdb
import pytest

from loomery.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, duck, name):
    got = Q.queries()[name](spark, DATA)
    want = duck.execute(Q.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted([plain(v) for v in r] for r in got.select(*names).collect()) == sorted([plain(v) for v in r] for r in want.fetchall())
