"""Registered queries against their SQL on the smallest tables, where those are present."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(df):
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr), list(df.columns)


@pytest.mark.parametrize("name", sorted(entry.core.ORACLES))
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    key = lambda x: [str(y) for y in x]
    got, cols = norm(entry.queries()[name](spark, SF).toPandas())
    want, want_cols = norm(c.sql(entry.oracle_sql()[name]).df())
    assert cols == want_cols
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
