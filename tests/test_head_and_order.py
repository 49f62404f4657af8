"""Head elements as a document's tree has them, and URLs in collated order."""

from __future__ import annotations

import html as stdlib_html

from pyspark.sql import functions as F

from crawlscope.functions import head
from crawlscope.operators import checks, crosspage, robots, sitemaps

LONG = "x" * 20_000


def heads(spark, texts):
    df = spark.createDataFrame([(i, t, 200) for i, t in enumerate(texts)], "i int, body string, status int")
    return [tuple(r) for r in checks.extract_metadata(df).orderBy("i").select("title", "description", "canonical", "noindex").collect()]


def test_what_hides_markup(spark):
    cases = {
        "<!-- <title>no</title> --><title>yes</title>": "yes",
        "<!--><title>still hidden</title>--><title>yes</title>": "yes",
        "<script>'<title>no</title>'</script><title>yes</title>": "yes",
        "<script><!-- </script><title>yes</title>": "yes",
        "<SCRIPT src='a>b'>1</SCRIPT ><title>yes</title>": "yes",
        "<style>/* <title>no</title>": None,
        "<title>a <b>bold</b> <!-- word --></title>": "a <b>bold</b> <!-- word -->",
        "<title><script></title><script>'</title>'</script>": "<script>",
        "<title\nlang=\"a>b\">yes</TITLE>": "yes",
        "<titles>no</titles><title>yes": "yes",
        "<title></title><title>second</title>": None,
        "": None,
        f"<!--{LONG}--><script>{LONG}</script><title>{LONG[:80]}</title>": LONG[:80],
        f"<meta content='{LONG}'><title a=\"{LONG}\">yes</title>": "yes",
    }
    assert [r[0] for r in heads(spark, [*cases, None])] == [*cases.values(), None]


def test_attributes(spark):
    cases = [
        ("<meta name=description content=one>", ("one", None, False)),
        ("<meta content='a \"b\"' name=\"description\">", ('a "b"', None, False)),
        ("<META NAME='description' CONTENT='x > y'/>", ("x > y", None, False)),
        ("<meta name='Description' content='no'><meta name='description' content='yes'>", ("yes", None, False)),
        ("<meta data-name='description' content='no'>", (None, None, False)),
        ("<meta title='name=description' content='no'>", (None, None, False)),
        ("<meta name='description'><meta name='description' content='second'>", (None, None, False)),
        ("<meta name='robots' content='NOINDEX, nofollow'><link rel='Canonical' href='/a?b=1&amp;c=2'>", (None, "/a?b=1&c=2", True)),
        ("<link rel='alternate canonical' href='/no'><link href=/yes rel=canonical>", (None, "/yes", False)),
        ("<textarea><meta name=robots content=noindex></textarea><!-- <link rel=canonical href=/no> -->", (None, None, False)),
        ("<metadata name=description content=no>", (None, None, False)),
    ]
    assert [r[1:] for r in heads(spark, [c for c, _ in cases])] == [w for _, w in cases]


def test_entities(spark):
    texts = ["&amp;lt; &lt;b&gt; &eacute;&Eacute; &hellip;", "&#233;&#xE9;&#XE9; &#x1F600;", "&#150;&#x80;&#0;&#xD800;&#x110000;&#99999999999;", "&copy 1 &nosuch; &; & && &#; &#x;", "&notin; &not; &AMP &CounterClockwiseContourIntegral; &fjlig;", "plain", "", "a&#10;b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(head.decode_all(F.col("t"))).collect()]
    # The standard library decodes as the standard does; it leaves &#; as it is, too.
    assert got == [stdlib_html.unescape(t) for t in texts]


def test_collated_order(spark):
    urls = [f"https://e.com/{p}" for p in ("B", "a", "A", "b", "é", "f", "_x", "a-b", "ab")]
    entries = spark.createDataFrame([("s", u) for u in urls], "site string, url string")
    first = lambda n, c: {r.url[14:] for r in sitemaps.cap_pages(entries, n, c).collect()}
    assert first(3, None) == {"A", "B", "_x"} and first(3, "UNICODE") == {"_x", "a", "A"}
    assert first(7, "UNICODE") == {"_x", "a", "A", "a-b", "ab", "b", "B"} and first(8, "UNICODE") - first(7, "UNICODE") == {"é"}
    deep = {r.url[14:] for r in checks.deep_sample(entries, 2, "UNICODE").where("deep_checked").collect()}
    assert deep == {"_x", "a"}
    pages = entries.where("url LIKE '%/a' OR url LIKE '%/B'").selectExpr("site", "url", "'https://e.com/k' AS canonical", "url AS final_url", "'t' AS title", "'d' AS description", "'l' AS lastmod", "200 AS status")
    assert [r.url[14:] for r in crosspage.dedupe_pages(pages)[0].collect()] == ["B"]
    assert [r.url[14:] for r in crosspage.dedupe_pages(pages, "UNICODE")[0].collect()] == ["a"]


def test_many_robots_rules(spark):
    """Sites with ten thousand rules, and few, against plain matching; most rules are never tried."""
    import random
    import re

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    made = [f"/{word(4)}/{word(3)}" + rng.choice(["", "", "/", "*", "$", "*b$", "?x=*"]) for _ in range(9_990)] + ["/*aa", "/", "*cc$", "nowhere", "/*", "/é", "/$", "/a.b", "/%C3%A9*"]
    lines = [(rng.random() < 0.5, p) for p in dict.fromkeys(made)]
    text = lambda rules: "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules)
    sites = {"large": lines, "small": lines[:20], "none": []}
    paths = sorted({f"/{word(4)}/{word(3)}" + rng.choice(["", "/x", "?x=1", "b", "/"]) for _ in range(400)} | {"/", "/%C3%A9", "/a.b", "/axb"})
    groups, rules, _ = robots.robots_rules(spark.createDataFrame([(s, text(r)) for s, r in sites.items()], "site string, body string"))
    urls = spark.createDataFrame([(s, f"https://e.com{p}", i) for s in sites for i, p in enumerate(paths)], "site string, url string, rules int")
    got = {(r.site, r.url[13:]): r.allowed for r in robots.robots_verdict(urls, groups, rules).collect()}
    for s, ruled in sites.items():
        tried = [(len(p) * 2 + a, re.compile("".join(".*" if c == "*" else re.escape(c) for c in p.removesuffix("$")) + (r"\Z" if p.endswith("$") else ""))) for a, p in ruled]
        for p in paths:
            best = max((v for v, x in tried if x.match(p)), default=1)
            assert got[s, p] == (best % 2 == 1), (s, p)
