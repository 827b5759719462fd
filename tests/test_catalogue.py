"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from graphloom.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, bool) or isinstance(v, int):
        return int(v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"soft_tree", "balanced_kmeans"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
