"""Every registered query of the rest against its own oracle, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from driftlens.plans import meta, surface

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = meta.QUERIES | surface.QUERIES, meta.ORACLE_SQL | surface.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def text(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE:
        assert got
        return
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())
