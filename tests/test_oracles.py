"""Every query with SQL gives DuckDB's result on the smallest tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import oracle_sql, queries
from foliant.plans.catalog import REGISTRY

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", list(REGISTRY.queries))
def test_query(spark, duck, name):
    df = REGISTRY.queries[name](spark, DIR)
    got = rows(df.columns, df.collect())
    if name not in REGISTRY.oracles:
        assert got
        return
    want = duck.execute(REGISTRY.oracles[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in queries() if n not in REGISTRY.queries])
def test_optional_query(spark, duck, name):
    df = queries()[name](spark, DIR)
    got = rows(df.columns, df.collect())
    if name not in oracle_sql():
        assert got
        return
    want = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, want.fetchall())
