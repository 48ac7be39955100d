"""Queries with SQL against DuckDB on the smallest tables, and URL verdicts on pages with links."""

import os
import random

import pytest

pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")

from millrace.llm import queries, urls

DATA = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(c.execute(queries.ORACLE_SQL[name]).fetchdf())


def test_verdicts_with_links(spark):
    import pandas as pd

    g = random.Random(1)
    hosts = [f"h{k}.{t}" for k in range(12) for t in ("com", "net", "org")] + ["a.example.net", "example.com"]
    link = lambda: f'<a href="http://{g.choice(hosts)}/x">y</a>'
    data = [
        (k, f"http://{g.choice(hosts).upper()}/{g.choice(['en', 'fr', 'de'])}/{k}?q", " ".join(link() for _ in range(g.randint(0, 3))))
        for k in range(200)
    ] + [(400, None, None), (401, "x", None)]
    c = duckdb.connect()
    c.register("pages", pd.DataFrame(data, columns=["page_id", "url", "html"]))
    got = urls.judge_urls(spark.createDataFrame(data, "page_id long, url string, html string")).drop("trust", "distrust")
    assert rows(got.toPandas()) == rows(c.execute(urls.ORACLE_SQL).fetchdf())
