"""Every market-data query against its SQL, over the driver's tables."""

import glob
import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
from marketlab.plans import queries as q  # noqa: E402

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if pd.isna(v):
            return None
        if hasattr(v, "isoformat"):
            return str(v)[:19].removesuffix(" 00:00:00")
        return v + 0.0 if isinstance(v, float) else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_matches_sql(spark, con, name):
    got = rows(q.QUERIES[name](spark, SF).toPandas())
    assert got
    if name in q.ORACLE_SQL:
        assert got == rows(con.sql(q.ORACLE_SQL[name]).df())
