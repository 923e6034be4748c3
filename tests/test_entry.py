"""Every registered query of this part against its SQL, on the smallest tables, where they are at hand."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessera.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
TABLES = "customer documents embeddings pages benchmark labels conversations events".split()


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) + 0.0 if isinstance(v, float) else v


def test_names():
    found = entry.queries()
    assert set(QUERIES) <= set(found) and set(entry.oracle_sql()) <= set(found)


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, str(DATA))
    want = con.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
