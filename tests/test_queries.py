"""Every query with SQL gives the rows that DuckDB gives over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from quire.plans import registry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, str(FOLDER))
    cols = sorted(df.columns)
    got = sorted([shown(r[c]) for c in cols] for r in df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted([shown(r[i]) for i in at] for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, str(FOLDER)).count() > 0
