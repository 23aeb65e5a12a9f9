"""Every query with SQL equals DuckDB's answer on the small tables; every other one yields rows."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
OWN = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def canonical(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            f = round(float(v), 5)
            return str(int(f)) if f == int(f) else str(f)
        return str(v)

    columns = sorted(df.columns)
    return sorted((tuple(one(v) if not isinstance(v, bool) else str(v) for v in row) for row in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    if name not in entry.oracle_sql():
        assert len(mine) > 0
        return
    theirs = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
