"""Every registered query runs; those with SQL agree with DuckDB on the given tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from siftline.plans import audit_queries, governed_queries, record_queries, text_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = audit_queries.QUERIES | governed_queries.QUERIES | record_queries.QUERIES | text_queries.QUERIES
SQL = audit_queries.sql() | governed_queries.sql() | record_queries.sql() | text_queries.sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or (not isinstance(x, list | tuple) and pd.isna(x)):
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(x).removesuffix(" 00:00:00")

    return sorted(tuple(cell(x) if not isinstance(x, int) else f"{x:.6g}" if abs(x) < 10**6 else str(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, sf, duck, name):
    got = OWN[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_importing_needs_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True)
