"""Every query that has SQL equals DuckDB's answer on the small tables; every other one runs and has rows."""

import math

import pytest

import __spark_entry__ as entry
from loomwork.plans import further  # noqa: F401
from loomwork.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in SQL:
        want = duck.execute(SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        a, b = rows(df.columns, got), rows(names, want.fetchall())
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 1e-4 for p, q in zip(x, y)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
