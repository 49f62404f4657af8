"""Sitemap files with many URLs, and URLs that need no parsing."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from crawlscope.functions import urls as U
from crawlscope.operators import sitemaps


def test_work_grows_with_the_urls(spark):
    """A broken file of 12,000 URLs, foreign ones first: each URL is looked at a few times, not once per other URL."""
    locs = [f"https://other.example/{i}" for i in range(3)] + [f"https://e.com/en/{i}" for i in range(12_000)]
    body = "<urlset>" + "".join(f"<url><loc>{u}</loc><lastmod>2024-01-{i % 28 + 1:02}</lastmod></url>" for i, u in enumerate(locs)) + "<broken"
    docs = spark.createDataFrame([("https://e.com/sitemap.xml", True, None, body)], "url string, ok boolean, error string, body string")
    seeds = spark.createDataFrame([("e.com", "https://e.com/sitemap.xml", 0)], "site string, sitemap_url string, pos int")
    began = time.perf_counter()
    files = sitemaps.expand_sitemaps(seeds, docs, "preview", max_files=9, max_urls=100_000)
    assert time.perf_counter() - began < 40
    rows = sitemaps.sitemap_entries(files, docs, "preview").select("url", "lastmod").collect()
    assert {r.url for r in rows} == set(locs[3:]) and all(r.lastmod for r in rows)


def test_plain_urls(spark):
    """What a match tells of a plain URL is what parsing tells; other forms are parsed."""
    hosts = ["https://e.com", "http://a-b.e.com", "https://E.com", "https://e.com:443", "https://u@e.com"]
    rest = ["", "/", "/a", "/a/", "/a/.b", "/a/../b", "/index.html", "/index.htm?x=1", "/a/index.html", "/a?", "/a?x=1&y=%20", "/a#f", "/a%2e", "/a b", "/sitemap.xml", "?q", "//a"]
    rows = spark.createDataFrame([(h + r,) for h in hosts for r in rest] + [(None,), ("no url",), ("/a",)], "u string")
    c, part = F.col("u"), lambda f: U.let(U.parse(F.col("u")), f)
    same = {
        "norm": (U.norm_url(c), part(U._norm)), "key": (U.dedupe_key(c), part(U._key)), "host": (U.url_host(c), part(lambda s: s["host"])), "path": (U.path(c), part(lambda s: s["path"])),
        "shown": (U.display_path(c), part(lambda s: F.concat(s["path"], s["search"]))),
    }
    bad = rows.select("u", *[(~a.eqNullSafe(b)).alias(n) for n, (a, b) in same.items()]).where(" OR ".join(same)).collect()
    assert bad == []
