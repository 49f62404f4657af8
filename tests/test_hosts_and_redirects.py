"""Hosts in their ASCII form, and redirect chains by doubling, against plain walks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from crawlscope.functions import urls as U
from crawlscope.functions.idna import ascii_host
from crawlscope.operators import redirects
from crawlscope.sources.fetch_log import fetch_log_of


def test_internationalised_hosts(spark):
    """Labels against Python's own Punycode, and both spellings of a URL in one normal form."""
    random.seed(1)
    chars = [range(97, 123), range(0xE0, 0xF6), range(0x430, 0x44F), range(0x4E00, 0x9000), range(0x1F600, 0x1F640)]
    labels = ["b\u00fccher", "a-b", "\u00fc", "\u00fc\u00fc-\u00fc", "\u4ed6\u4eec\u4e3a\u4ec0\u4e48\u4e0d\u8bf4\u4e2d\u6587", "-> 1 <-\u00e9"]
    labels += ["".join(chr(random.choice(random.choice(chars))) for _ in range(random.choice([1, 3, 8, 20, 63]))) for _ in range(60)]
    want = [(x, x if x.isascii() else f"xn--{x.encode('punycode').decode()}") for x in labels]
    made = spark.createDataFrame(want, "label string, want string").select("want", ascii_host(F.col("label")).alias("got"))
    assert [r for r in made.collect() if r.want != r.got] == []
    urls = [("https://WWW.B\u00fccher.Example/a/",), ("https://www.xn--bcher-kva\u3002example/a",)]
    with U.ascii_hosts():
        out = spark.createDataFrame(urls, "u string").select(*[f(F.col("u")).alias(n) for n, f in (("n", U.norm_url), ("k", U.dedupe_key), ("s", U.norm_site))])
    whole = "https://www.xn--bcher-kva.example/a"
    assert {r.n for r in out.collect()} == {r.k for r in out.collect()} == {r.s for r in out.collect()} == {whole}
    long = "\u00e9" * 300
    assert spark.createDataFrame([(long,), (None,)], "h string").select(ascii_host(F.col("h")).alias("h")).collect() == [(long,), (None,)]


def test_redirect_to_the_other_spelling(spark):
    """A location that spells the host with its own characters leads to the page logged under the ASCII form."""
    schema = "url string, status int, location string, body string"
    name = "https://xn--bcher-kva.example"
    rows = [(f"{name}/a", 301, "https://B\u00fccher.example/b", None), (f"{name}/b", 200, None, "x")]
    with U.ascii_hosts():
        out = redirects.resolve_redirects(spark.createDataFrame([(f"{name}/a",)], "start_url string"), fetch_log_of(spark.createDataFrame(rows, schema)))
    assert [(r.status, r.final_url, r.n_hops) for r in out.collect()] == [(200, f"{name}/b", 1)]


def test_redirect_limits(spark):
    """Chains by doubling against a walk hop by hop, at every limit."""
    random.seed(2)
    hops = {f"https://e.com/{i}": f"https://e.com/{random.randrange(60)}" for i in range(45)} | {f"https://f.com/{i}": f"https://f.com/{i + 1}" for i in range(15)}
    schema = "url string, status int, location string, body string, content_type string, final_url string, error string"
    rows = [(u, 302, t, None, None, None, None) for u, t in hops.items()] + [(f"https://e.com/{i}", 200, None, "x", None, None, None) for i in range(45, 55)]
    pages = {u for u, *_ in rows}

    def walk(url, limit):
        seen, n = [], 0
        while url in hops:
            if n > limit:
                return 310, url, n, False, True
            seen, last, url, n = seen + [url], seen, hops[url], n + 1
            if url in last:
                return 302, url, n, True, False
        if n > limit:
            return 310, url, n, False, True
        return (200, url, n, False, False) if url in pages else (None, None, 0, False, False)

    starts = spark.createDataFrame([(u,) for u in sorted(pages)], "start_url string")
    for limit in (0, 2, 10):
        out = redirects.resolve_redirects(starts, fetch_log_of(spark.createDataFrame(rows, schema)), limit)
        got = {r.start_url: tuple(r)[1:] for r in out.select("start_url", "status", "final_url", "n_hops", "loop", "truncated").collect()}
        assert got == {u: walk(u, limit) for u in pages}
