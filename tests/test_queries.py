"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"

OWN = {n for plan in entry.PLANS for n in plan.QUERIES}
SQL = {n: s for n, s in entry.oracle_sql().items() if n in OWN}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if pd.isna(x):
            return "null"
        return repr(float(x) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else repr(x.item() if hasattr(x, "item") else x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(object)) == rows(want.astype(object))


@pytest.mark.parametrize("name", sorted(OWN - SQL.keys()))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
