"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from strainframe import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    shown = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for _, v in sorted(zip(columns, r, strict=True))) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    cursor = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["monday", "week", "samples"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
