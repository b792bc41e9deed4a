"""Each query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from dispatchlake.plans import curation, decisions, incidents, places, records, rules, texts  # noqa: F401
from dispatchlake.plans.registry import ORACLE, QUERIES
from dispatchlake.views import TABLES

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or (isinstance(x, float) and pd.isna(x)) or x is pd.NaT or x is pd.NA:
            return "null"
        if isinstance(x, float) or hasattr(x, "dtype"):
            return f"{float(x):.6f}"
        return f"{x:.6f}" if isinstance(x, int) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
