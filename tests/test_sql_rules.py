"""Queries and their SQL on rows that the given tables have only when they are large."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from crawlscope.operators import redirects
from crawlscope.oracle import ORACLE_SQL
from crawlscope.queries import QUERIES
from crawlscope.sources.fetch_log import fetch_log_of


@pytest.fixture(scope="module")
def pages_dir(spark, tmp_path_factory):
    """Titles that end within an entity, hidden and odd markup, and URLs that several pages have."""
    path = str(tmp_path_factory.mktemp("rules"))
    titles = ["cut &&&amp", "&amp&amp;&lt;b&gt; kept &ampx", "&copy 1 &#150;&#x1F600; &nosuch; &#;", "<b>&amp;lt;</b>", " &nbsp; "]
    html = [f"<html><head><!-- <title>no</title> --><script>'<title>no</title>'</script><title a='>'>{t}</title></head>" for t in titles]
    rows = [(i, f"https://e.com/en/{i % 61}", html[i % 5]) for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["f_metadata", "e_redirect_chain"])
def test_query_and_sql(spark, pages_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{pages_dir}/pages.parquet/*.parquet'")
    got = QUERIES[name](spark, pages_dir)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_repeated_urls_of_a_log(spark):
    """Whatever the order of rows, the same hop and the same end."""
    rows = [("https://e.com/a", 302, "https://e.com/c", None), ("https://e.com/a", 301, "https://e.com/b", None), ("https://e.com/a", 200, None, "x")]
    rows += [("https://e.com/b", 200, None, "x"), ("https://e.com/b", 404, None, "y"), ("https://e.com/b", None, None, None), ("https://e.com/b", 404, None, "z")]
    starts = spark.createDataFrame([("https://e.com/a",)], "start_url string")
    for order in (rows, rows[::-1]):
        log = fetch_log_of(spark.createDataFrame(order, "url string, status int, location string, body string").coalesce(1))
        out = redirects.resolve_redirects(starts, log).select("status", "final_url", "body", "n_hops", F.col("chain")[0]["status"]).collect()
        assert [tuple(r) for r in out] == [(404, "https://e.com/b", "z", 1, 301)]
