"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from siteoverlap.plans import oracles, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cur = duck.execute(oracles.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted([cell(r[columns.index(c)]) for c in order] for r in cur.fetchall())
    assert sorted([cell(r[c]) for c in order] for r in df.collect()) == want


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"chrom", "p_value"} <= set(rows[0].asDict())
    assert set(entry.oracle_sql()) <= set(entry.queries())
