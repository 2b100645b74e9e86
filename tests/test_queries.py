"""Every registered query of the analytics operators against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from metaloom import catalog_queries as cq
from metaloom import index_queries as iq
from metaloom import tree_queries as tq

TABLES = (*cq.TABLES, "benchmark", "labels")
QUERIES, ORACLE_SQL = cq.QUERIES | iq.QUERIES | tq.QUERIES, cq.ORACLE_SQL | iq.ORACLE_SQL | tq.ORACLE_SQL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return con


def value(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    got = sorted((tuple(map(value, r)) for r in df.select(columns).collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    found = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(value(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
