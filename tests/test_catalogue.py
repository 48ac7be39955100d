"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import os

import pandas as pd
import pytest

from millrace.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if pd.isna(v):
        return None
    if isinstance(v, (bool, str)):
        return str(v)
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)[:26].replace(" 00:00:00", "")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(
        (tuple(map(plain, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False)), key=repr
    )
    assert rows(got) == rows(want)
