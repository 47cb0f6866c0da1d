"""Every query with SQL, against that SQL on another engine."""

import os

import duckdb
import pandas as pd
import pytest

from corpuswright import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        numeric = df[c].dtype.kind in "fiu"
        df[c] = df[c].map(lambda x, n=numeric: "null" if x is None or x is pd.NaT or x != x else f"{float(x):.6g}" if n and abs(x) < 1e6 else str(int(x)) if n else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got, want = norm(Q.queries()[name](spark, SF).toPandas()), norm(con.sql(Q.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0
