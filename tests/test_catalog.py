"""Every query with SQL equals it on the smallest tables."""

import duckdb
import pytest

from locusflow.plans import further as catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if got[c].dtype.kind in "if":
            want[c] = want[c].astype(got[c].dtype)
    assert rows(got) == rows(want)
