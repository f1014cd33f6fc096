"""Every query with SQL against DuckDB on the smallest tables, and the driver's entry points."""

import os

import pytest

import __spark_entry__ as entry
from scrivena.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return con


def rows(frame, columns):
    out = []
    for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist():
        out.append(str([float(x) if type(x).__name__ in ("Decimal", "int", "float", "float64") else x for x in r]))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_duckdb(spark, connection, name):
    found = catalog.QUERIES[name](spark, DATA).toPandas()
    expected = connection.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert len(found) and rows(found, columns) == rows(expected, columns)


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"per_author_metrics", "split_latest_n"} <= set(entry.queries())
