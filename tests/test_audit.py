"""Golden cases of the audit: URLs, robots, sitemaps, redirects, checks, scores and sinks."""

from __future__ import annotations

import csv
import glob
import json
import warnings

import pytest
from pyspark.sql import functions as F

from crawlscope.functions import text as T
from crawlscope.functions import urls as U
from crawlscope.operators import checks, crosspage, redirects, robots, scores, sitemaps
from crawlscope.plans import reports
from crawlscope.plans.audit import PREVIEW, AuditConfig, run_audit
from crawlscope.scratch import scratch_root
from crawlscope.sources import sinks
from crawlscope.sources.fetch_log import SCHEMA, fetch_log_of
from crawlscope.streaming.run_counters import run_counters, stream_run_counters

DESC = "A sixty character description for the page under test here."


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, a string" + (", b string" if isinstance(values[0], tuple) else ""))
    return [tuple(r) for r in df.select("i", *exprs).orderBy("i").drop("i").collect()]


def test_url_forms(spark):
    a = F.col("a")
    urls = ["https://Example.com:443/a//?x=1#f", "http://e.com", "https://e.com/x/?", "https://u:p@e.com/index.html", "https://e.com:8443/a/../b/./c/", "ftp://e.com/x", "a|b c", None, "https://e.com/a bé"]
    assert column(spark, urls, U.norm_url(a), U.dedupe_key(a)) == [
        ("https://example.com/a?x=1", "https://example.com/a?x=1"),
        ("http://e.com/", "http://e.com/"),
        ("https://e.com/x?", "https://e.com/x"),
        ("https://u:p@e.com/index.html", "https://e.com/"),
        ("https://e.com:8443/b/c", "https://e.com:8443/b/c"),
        (None, None),
        (None, None),
        (None, None),
        ("https://e.com/a%20b%C3%A9", "https://e.com/a%20b%C3%A9"),
    ]
    assert column(spark, ["Example.com/", "http://e.com/a/?q#f"], U.norm_site(a)) == [("https://example.com",), ("http://e.com/a",)]


def test_url_classes(spark):
    a = F.col("a")
    urls = ["https://e.com/c/ai?page=10", "https://e.com/archive/2", "https://e.com/cluster/x", "https://e.com/canvas/1", "https://e.com/", "https://e.com/about", "https://e.com/a/b", "https://e.com/tag/x", "https://e.com/a/b?page=2", "https://e.com/sources/1", "https://e.com/story"]
    got = column(spark, urls, U.page_type(a), U.section(a), U.page_type(a, "preview"))
    assert got[0] == ("category_page", "c/ai", "category")
    assert [g[0] for g in got[1:]] == ["archive", "cluster", "canvas", "home", "static", "generated", "category", "category_page", "source", "story"]
    assert [g[1] for g in got[1:4]] == ["archive", "cluster", "canvas/archive"]
    assert column(spark, ["www.e.com", "https://e.com/Sitemap.XML.gz"], U.input_mode(a)) == [("site",), ("sitemap",)]
    assert column(spark, ["https://www.e.com", "https://e.com:81/x"], U.host_variants(a)) == [(["https://www.e.com", "https://e.com"],), (["https://e.com:81", "https://www.e.com"],)]


def test_resolve(spark):
    pairs = [("/x", "https://e.com/a/b?q"), ("c", "https://e.com/a/b"), ("../c", "https://e.com/a/b/d"), ("//h.org/p", "http://e.com/"), ("?z", "https://e.com/a"), ("http://[", "https://e.com/"), ("mailto:x", "https://e.com/")]
    assert [r[0] for r in column(spark, pairs, U.resolve_url(F.col("a"), F.col("b")))] == ["https://e.com/x", "https://e.com/a/c", "https://e.com/a/c", "http://h.org/p", "https://e.com/a?z", None, None]


def test_text(spark):
    a = F.col("a")
    assert column(spark, ["a   b﻿", "  ", "&lt;b&gt;x&lt;/b&gt; &amp;amp; y"], T.collapse(a), T.clean_html(a)) == [("a b", "a b"), (None, None), ("&lt;b&gt;x&lt;/b&gt; &amp;amp; y", "x &amp; y")]
    assert column(spark, ["\U0001f600a", "MISSING_TITLE", "static"], T.utf16_length(a), T.humanize(a))[0][0] == 3
    assert column(spark, ["category_page"], T.humanize(a)) == [("Category Page",)]


ROBOTS = [
    ("empty", "", "/x", True, "*"),
    ("private", "User-agent: *\nDisallow: /private", "/private/page", False, "*"),
    ("private2", "User-agent: *\nDisallow: /private", "/public", True, "*"),
    ("nothing", "User-agent: *\nDisallow:", "/x", True, "*"),
    ("all", "User-agent: *\nDisallow: /", "/page", False, "*"),
    ("longest", "User-agent: *\nDisallow: /folder\nAllow: /folder/public", "/folder/public", True, "*"),
    ("longest2", "User-agent: *\nDisallow: /folder\nAllow: /folder/public", "/folder/secret", False, "*"),
    ("tie", "User-agent: *\nDisallow: /a\nAllow: /a", "/a", True, "*"),
    ("pdf", "User-agent: *\nDisallow: /*.pdf$", "/docs/report.pdf", False, "*"),
    ("pdf2", "User-agent: *\nDisallow: /*.pdf$", "/docs/report.pdf?v=2", True, "*"),
    ("bot", "User-agent: badbot\nDisallow: /\n\nUser-agent: *\nDisallow: /admin", "/home", False, "BadBot"),
    ("bot2", "User-agent: badbot\nDisallow: /\n\nUser-agent: *\nDisallow: /admin", "/home", True, "Googlebot"),
    ("void", "User-agent: badbot\nDisallow:\nUser-agent: *\nDisallow: /", "/home", True, "badbot"),
    ("shared", "﻿User-agent: a\nUser-agent: badbot\nCrawl-delay: 1\nDisallow: /x # no\nUser-agent: z\nDisallow: /y", "/x", False, "badbot"),
    ("shared2", "User-agent: a\nDisallow: /x\nUser-agent: badbot\nDisallow: /y", "/x", True, "badbot"),
]


@pytest.mark.parametrize("agent", ["*", "badbot", "Googlebot"])
def test_robots(spark, agent):
    rows = [r for r in ROBOTS if r[4].lower() == agent.lower()]
    groups, rules, _ = robots.robots_rules(spark.createDataFrame([(r[0], r[1]) for r in rows], "site string, body string"))
    urls = spark.createDataFrame([(r[0], f"https://e.com{r[2]}") for r in rows], "site string, url string")
    got = {r.site: r.allowed for r in robots.robots_verdict(urls, groups, rules, agent).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_directives(spark):
    df = spark.createDataFrame([("s", "Sitemap: https://e.com/sitemap.xml\nUser-agent: *\nSITEMAP : https://e.com/llms.txt")], "site string, body string")
    assert [(r.sitemap_url, r.usable) for r in robots.sitemap_directives(df).orderBy("pos").collect()] == [("https://e.com/sitemap.xml", True), ("https://e.com/llms.txt", False)]
    assert robots.robots_rules(df)[2].count() == 2


def log(spark, rows):
    cols = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return fetch_log_of(spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], SCHEMA))


def test_redirects(spark):
    hop = lambda a, b, s=301: {"url": f"https://e.com/{a}", "status": s, "location": b}
    rows = [hop("a", "https://e.com/b"), hop("b", "/c"), {"url": "https://e.com/c", "status": 200, "body": "x"}, hop("p", "q"), hop("q", "p"), hop("s", "s"), hop("gone", "/nowhere")]
    rows += [hop(f"n{i}", f"n{i + 1}") for i in range(20)]
    starts = spark.createDataFrame([(f"https://e.com/{x}",) for x in ("a", "c", "p", "s", "gone", "n0")], "start_url string")
    got = {r.start_url[14:]: r for r in redirects.resolve_redirects(starts, log(spark, rows)).collect()}
    assert (got["a"].status, got["a"].n_hops, got["a"].final_url, got["a"].body) == (200, 2, "https://e.com/c", "x")
    assert [h.location for h in got["a"].chain] == ["https://e.com/b", "https://e.com/c"]
    assert (got["c"].n_hops, got["c"].loop) == (0, False)
    assert (got["p"].loop, got["p"].n_hops) == (True, 2)
    assert (got["s"].loop, got["s"].n_hops) == (True, 2)
    assert (got["gone"].status, got["gone"].n_hops, got["gone"].final_url) == (None, 0, None)
    assert (got["n0"].status, got["n0"].truncated, got["n0"].n_hops) == (310, True, 11)


def page(title="About Acme Widgets", desc=DESC, canonical="https://example.com/about", noindex=False):
    return (
        "<html><head>"
        + (f"<title>{title}</title>" if title is not None else "")
        + (f'<meta name="description" content="{desc}">' if desc is not None else "")
        + (f'<link rel="canonical" href="{canonical}">' if canonical else "")
        + ('<meta content="noindex" name="robots">' if noindex else "")
        + "</head><body>ok</body></html>"
    )


A, GEN = "https://example.com/about", "https://example.com/cluster/abc"
GOOD = {"url": A, "status": 200, "final_url": A, "lastmod": "2026-06-01", "n_hops": 0, "loop": False}
CASES = [
    (page(), {}, {}, ["MISSING_TITLE", "SHORT_TITLE", "REDIRECTED_URL", "CANONICAL_MISMATCH"]),
    (page(title=None), {}, {"MISSING_TITLE": "warning"}, []),
    (page(title=None), {"url": GEN, "final_url": GEN}, {"MISSING_TITLE": "notice"}, []),
    (page(title="Hi"), {}, {"SHORT_TITLE": "notice"}, []),
    (page(title="A" * 80), {}, {"LONG_TITLE": "warning"}, []),
    (page(title="A" * 80), {"url": GEN, "final_url": GEN}, {"LONG_TITLE": "notice"}, []),
    (page(desc=None), {}, {"MISSING_META_DESCRIPTION": "warning"}, []),
    (page(desc="Too short."), {}, {"SHORT_META_DESCRIPTION": "notice"}, []),
    (page(desc="B" * 200), {}, {"LONG_META_DESCRIPTION": "warning"}, []),
    (page(canonical=None), {}, {"MISSING_CANONICAL": "notice"}, []),
    (page(canonical="https://elsewhere.com/about"), {}, {"CANONICAL_CROSS_HOST": "warning"}, []),
    (page(canonical="/other"), {}, {"CANONICAL_MISMATCH": "notice"}, []),
    (page(canonical=A), {}, {}, ["CANONICAL_CROSS_HOST", "CANONICAL_MISMATCH"]),
    (page(canonical="https://example.com/about-us"), {"final_url": "https://example.com/about-us"}, {"REDIRECTED_URL": "warning"}, ["CANONICAL_MISMATCH"]),
    (page(), {"status": 404}, {"BAD_STATUS": "error"}, []),
    (page(), {"status": 301}, {"REDIRECT_STATUS": "warning"}, []),
    (None, {"status": None, "final_url": None}, {"FETCH_FAILED": "error"}, []),
    (page(), {"final_url": A + "/"}, {}, ["REDIRECTED_URL"]),
    (page(), {"n_hops": 2}, {"REDIRECT_CHAIN": "warning"}, ["REDIRECTED_URL"]),
    (page(), {"n_hops": 2, "loop": True}, {"REDIRECT_LOOP": "error"}, ["REDIRECT_CHAIN"]),
    (page(noindex=True), {}, {"NOINDEX_IN_SITEMAP": "error"}, []),
    (page(), {"lastmod": None}, {"MISSING_LASTMOD": "warning"}, []),
    (page(), {"url": GEN, "final_url": GEN, "lastmod": None}, {"MISSING_LASTMOD": "notice"}, []),
]


def test_page_checks(spark):
    fields = ["url", "status", "final_url", "lastmod", "n_hops", "loop"]
    rows = [(str(i), html, *[(GOOD | change)[f] for f in fields]) for i, (html, change, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "site string, body string, url string, status int, final_url string, lastmod string, n_hops int, loop boolean")
    got = {int(r.site): r for r in checks.check_pages(checks.extract_metadata(df)).collect()}
    assert not got[0].issues and got[0].ok
    for i, (_, _, want, never) in enumerate(CASES):
        codes = {x.code: x.severity for x in got[i].issues}
        assert want.items() <= codes.items(), (i, codes)
        assert not set(never) & set(codes), (i, codes)
        assert got[i].ok == ("error" not in codes.values())


def test_best_of(spark):
    cols = "site string, url string, title string, description string, canonical string, final_url string, lastmod string, status int"
    rows = [
        ("s", "https://e.com/a", "t", None, "/x", "https://e.com/a", None, 200),
        ("s", "https://e.com/b", "t", None, "https://e.com/x/", "https://e.com/b", None, 200),
        ("s", "https://e.com/c", "t", "d", "https://e.com/x?", "https://e.com/c", None, 200),
        ("s", "https://e.com/d", None, None, None, None, None, None),
    ]
    kept, dropped = crosspage.dedupe_pages(spark.createDataFrame(rows, cols))
    assert sorted(r.url[-1] for r in kept.collect()) == ["c", "d"]
    assert [(r.site, r.dropped) for r in dropped.collect()] == [("s", 2)]


def urlset(*urls):
    items = "".join(f"<url><loc>{u}</loc>{f'<lastmod>{m}</lastmod>' if m else ''}</url>" for u, m in urls)
    return f'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{items}</urlset>'


def test_sitemaps(spark):
    base = "https://e.com"
    index = f"<sitemapindex><sitemap><loc>{base}/child.xml</loc></sitemap><sitemap><loc>{base}/broken.xml</loc></sitemap><sitemap><loc>{base}/missing.xml</loc></sitemap></sitemapindex>"
    docs = [
        (f"{base}/sitemap.xml", True, None, index),
        (f"{base}/child.xml", True, None, urlset((f"{base}/one/", None), (f"{base}/two", "2026-01-01"), ("https://other.com/x", None))),
        (f"{base}/broken.xml", True, None, f"<urlset><url><loc>{base}/three</loc><lastmod>2026-02-02</lastmod></url><url><loc>{base}/two</loc>"),
        (f"{base}/missing.xml", False, None, "gone"),
    ]
    docs = spark.createDataFrame(docs, "url string, ok boolean, error string, body string")
    seeds = spark.createDataFrame([(base, f"{base}/sitemap.xml", 0)], "site string, sitemap_url string, pos int")
    files = sitemaps.expand_sitemaps(seeds, docs)
    assert {(r.sitemap_url[14:], r.depth, r.loaded) for r in files.collect()} == {("sitemap.xml", 0, True), ("child.xml", 1, True), ("broken.xml", 1, True), ("missing.xml", 1, False)}
    got = {r.url[14:]: r.lastmod for r in sitemaps.sitemap_entries(files, docs).collect()}
    assert got == {"one": None, "two": "2026-01-01", "three": "2026-02-02"}
    assert [r.sitemap_url for r in sitemaps.failed_sitemaps(files).collect()] == [f"{base}/missing.xml"]
    assert {(r.sitemap_url[14:], (r.parent or "")[14:]) for r in sitemaps.sitemap_tree(files).collect()} >= {("child.xml", "sitemap.xml")}


def sites_log(spark):
    full = {"title": "A good long title here", "canonical": None}
    pages = {
        "site.test": [("/", full), ("/about", full), ("/no-title", full | {"title": None}), ("/dupe-a", full | {"title": "Identical Title Here"}), ("/dupe-b", full | {"title": "Identical Title Here"}), ("/gone", None), ("/noindexed", full | {"noindex": True}), ("/no-lastmod", full)],
        "thin.test": [("/", full)],
        "conflict.test": [("/", full), ("/secret/page", full)],
    }
    bodies = {"site.test": "User-agent: *\nSitemap: https://site.test/sitemap.xml\n", "thin.test": "User-agent: *\nDisallow:\n", "conflict.test": "User-agent: *\nDisallow: /secret\nSitemap: https://conflict.test/sitemap.xml\n", "redir.test": "Sitemap: https://redir.test/sitemap.xml\n"}
    rows = [{"url": f"https://{h}/robots.txt", "status": 200, "body": b} for h, b in bodies.items()]
    for host, listed in pages.items():
        maps = [(f"https://{host}{p}", None if p == "/no-lastmod" or host == "thin.test" else "2026-06-01") for p, _ in listed]
        rows.append({"url": f"https://{host}/sitemap.xml", "status": 200, "body": urlset(*maps)})
        rows += [{"url": f"https://{host}{p}", "status": 404 if kw is None else 200, "body": "gone" if kw is None else page(**kw)} for p, kw in listed]
    rows += [
        {"url": "https://redir.test/sitemap.xml", "status": 200, "body": urlset(("https://redir.test/old", "2026-06-01"))},
        {"url": "https://redir.test/old", "status": 301, "location": "https://redir.test/mid"},
        {"url": "https://redir.test/mid", "status": 301, "location": "/new"},
        {"url": "https://redir.test/new", "status": 200, "body": page(**full)},
    ]
    return log(spark, rows), spark.createDataFrame([(h,) for h in bodies], "site string")


@pytest.fixture(scope="module")
def audit(spark):
    fetch_log, sites = sites_log(spark)
    return run_audit(sites, fetch_log, AuditConfig())


def test_exact_scores(audit):
    got = {r.site[8:]: (r.pages, r.sections, r.errors, r.warnings, r.notices, r["index"], r.seo, r.sitemap) for r in audit.report.collect()}
    assert got == {
        "site.test": (8, 8, 2, 10, 15, 81, 63, 89),
        "thin.test": (1, 1, 0, 2, 2, 47, 97, 55),
        "conflict.test": (2, 2, 0, 4, 5, 64, 94, 80),
        "redir.test": (1, 1, 0, 2, 1, 47, 97, 65),
    }


def test_issue_codes(audit):
    root = {(r.site[8:], r.code) for r in audit.site_issues.collect()}
    assert {("thin.test", "ROBOTS_NO_SITEMAP_REFERENCE"), ("thin.test", "SINGLE_URL_SITEMAP"), ("conflict.test", "ROBOTS_SITEMAP_CONFLICTS")} <= root
    found = {(r.url[8:], r.code) for r in audit.page_issues.collect()}
    assert ("conflict.test/secret/page", "ROBOTS_DISALLOWED_IN_SITEMAP") in found and ("conflict.test/", "ROBOTS_DISALLOWED_IN_SITEMAP") not in found
    assert ("redir.test/old", "REDIRECT_CHAIN") in found
    assert [r.redirects for r in audit.pages.where("url = 'https://redir.test/old'").collect()] == [2]


def test_sinks(spark, audit, tmp_path):
    odd = audit.pages.withColumn("title", F.when(F.col("url").endswith("/about"), ' lead, "quoted"\nline').otherwise(F.col("title")))
    sinks.write_pages_csv(odd, audit.page_issues, str(tmp_path / "csv"), by_site=False)
    text = "".join(open(f, newline="").read() for f in sorted(glob.glob(str(tmp_path / "csv/*.csv")))[:1])
    rows = list(csv.reader(text.splitlines(keepends=True)))
    assert tuple(rows[0]) == sinks.CSV_COLUMNS
    about = next(r for f in glob.glob(str(tmp_path / "csv/*.csv")) for r in csv.reader(open(f, newline="")) if r and r[0] == "https://site.test/about")
    assert about[5] == ' lead, "quoted"\nline' and about[7] == ""
    result = sinks.audit_result(audit.report, audit.pages, audit.page_issues, audit.site_issues)
    sinks.write_index_json(result, str(tmp_path / "json"))
    docs = [json.loads(open(f).read()) for f in glob.glob(str(tmp_path / "json/*/*.txt"))]
    assert {d["site"]: len(d["pages"]) for d in docs}["https://site.test"] == 8
    assert all("description" not in p for d in docs for p in d["pages"] if p["url"].endswith("/gone"))


def test_preview(spark):
    fetch_log, sites = sites_log(spark)
    audit = run_audit(sites, fetch_log, PREVIEW)
    got = {r.site[8:]: r for r in audit.report.collect()}
    assert got["thin.test"].verdict.startswith("Single-page sitemap") and got["conflict.test"].verdict.startswith("Thin sitemap detected: only 2")
    assert got["site.test"].verdict.startswith("Compatible")
    assert got["site.test"]["index"] == 100 - 10 - 5


def test_discovery_notes(spark):
    host = "https://note.test"
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>{host}/{n}.xml</loc></sitemap>" for n in ("wall", "torn", "bare", "gone", "back")) + "</sitemapindex>"
    bodies = {
        "/robots.txt": f"Sitemap: {host}/sitemap.xml\nSitemap: {host}/llms.txt\n",
        "/sitemap.xml": index,
        "/wall.xml": "<html>Please solve the CAPTCHA</html>",
        "/torn.xml": f"<urlset><url><loc>{host}/a</loc></url><!-- cut",
        "/bare.xml": "<urlset><url><loc>https://else.test/x</loc></url></urlset>",
        "/back.xml": f"<sitemapindex><sitemap><loc>{host}/sitemap.xml</loc></sitemap></sitemapindex>",
    }
    rows = [{"url": host + p, "status": 200, "body": b} for p, b in bodies.items()] + [{"url": f"{host}/gone.xml", "status": None, "error": "timed out"}]
    audit = run_audit(spark.createDataFrame([(host,)], "site string"), log(spark, rows), PREVIEW)
    got = [r.message for r in audit.site_issues.where("code = 'DISCOVERY_NOTE'").orderBy("ord").collect()]
    empty = "loaded but produced 0 same-host sitemap children or URL entries."
    assert got == [
        f"{host}/wall.xml looks blocked or challenged by bot protection.",
        f"{host}/wall.xml {empty}",
        f"{host}/torn.xml XML parser fallback used: Comment is not closed.",
        f"{host}/bare.xml {empty}",
        f"{host}/gone.xml failed: timed out",
        f"{host}/back.xml {empty}",
    ]
    source = audit.report.first()
    assert source.tested_urls == [f"{host}/{n}" for n in ("robots.txt", "sitemap.xml", "wall.xml", "torn.xml", "bare.xml", "back.xml", "gone.xml")]
    assert source.failures == [f"Ignored non-XML Sitemap directive: {host}/llms.txt", *got]
    nested = sinks.audit_result(audit.report, audit.pages, audit.page_issues, audit.site_issues).first()
    assert nested.source.failures == source.failures and nested.source.discovered_url_count == 1 and nested.source.compatibility == source.verdict


def test_sources_of_the_preview(spark):
    page_map = lambda host: urlset((f"{host}/", "2026-01-01"), (f"{host}/a", "2026-01-01"))
    rows = [
        {"url": "https://bare.test/robots.txt", "status": 200, "body": "Sitemap: https://else.test/sitemap.xml\n" + "".join(f"Sitemap: https://bare.test/{i}.txt\n" for i in range(12))},
        {"url": "https://bare.test/sitemap.xml", "status": 200, "body": page_map("https://bare.test")},
        {"url": "https://down.test/robots.txt", "status": None, "error": "timed out"},
        {"url": "https://down.test/sitemap.xml", "status": 200, "body": page_map("https://down.test")},
        {"url": "https://given.test/robots.txt", "status": 200, "body": "Sitemap: https://given.test/notes.txt\n"},
        {"url": "https://given.test/map.xml", "status": 200, "body": page_map("https://given.test")},
    ]
    sites = spark.createDataFrame([("bare.test",), ("down.test",), ("https://given.test/map.xml",), ("absent.test",)], "site string")
    root = scratch_root(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    tables = lambda: {s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(root))}
    before = tables()
    with run_audit(sites, log(spark, rows), PREVIEW) as audit:
        assert len(tables() - before) == 1
        got = {r.site[8:]: r for r in audit.report.collect()}
    assert tables() == before
    ignored = [f"Ignored non-XML Sitemap directive: https://bare.test/{i}.txt" for i in range(10)]
    none = "loaded but did not expose usable same-host XML Sitemap directives."
    assert got["bare.test"].failures[:11] == [*ignored, f"https://bare.test/robots.txt {none}"]
    assert got["down.test"].failures[0] == "https://down.test/robots.txt failed: timed out"
    assert got["given.test"].failures == ["Direct sitemap input."]
    assert got["given.test"].tested_urls == ["https://given.test/robots.txt", "https://given.test/map.xml"]
    for site in ("bare.test", "down.test"):
        assert got[site].tested_urls[:2] == [f"https://{site}/robots.txt", f"https://{site}/sitemap.xml"]
        assert all(" failed: " in f for f in got[site].failures[11 if site == "bare.test" else 1 :])
    gone = next(r for s, r in got.items() if "absent" in s)
    assert gone.failures[0].startswith("https://") and len(gone.failures) == len(gone.tested_urls)


def test_index_in_parts(spark, audit, tmp_path):
    """A large site's pages are written by many tasks, and its parts together are the one document."""
    many = spark.range(400).select(F.concat(F.lit("https://site.test/z/"), F.format_string("%05d", "id")).alias("url"))
    base = audit.pages.where("url = 'https://site.test/about'").drop("url")
    pages = audit.pages.unionByName(base.crossJoin(many))
    sinks.write_index_parts(audit.report, pages, audit.page_issues, audit.site_issues, str(tmp_path / "parts"), parts=4)
    whole = {r["site"]: json.loads(r["doc"]) for r in sinks.audit_result(audit.report, pages, audit.page_issues, audit.site_issues).select("site", F.to_json(F.struct("*")).alias("doc")).collect()}
    heads = [json.loads(open(f).read()) for f in glob.glob(str(tmp_path / "parts/manifest/*/*.txt"))]
    assert {h["site"] for h in heads} == set(whole)
    for head in heads:
        site, listed = head["site"], []
        for part in head["page_parts"]:
            folder = f"{tmp_path}/parts/pages/site={site.replace(':', '%3A').replace('/', '%2F')}/part={part['part']}"
            lines = [json.loads(line) for f in sorted(glob.glob(f"{folder}/*.json")) for line in open(f)]
            assert (len(lines), lines[0]["url"], lines[-1]["url"]) == (part["pages"], part["first_url"], part["last_url"])
            listed += lines
        assert listed == whole[site]["pages"]
        assert {k: v for k, v in head.items() if k not in ("generated_at", "page_parts")} == {k: v for k, v in whole[site].items() if k not in ("generated_at", "pages")}
    large = next(h for h in heads if h["site"] == "https://site.test")
    assert len(large["page_parts"]) >= 3 and max(p["pages"] for p in large["page_parts"]) < 250
    sinks.write_pages_csv(pages, audit.page_issues, str(tmp_path / "csv"))
    urls = [r[0] for f in sorted(glob.glob(str(tmp_path / "csv/site=https%3A%2F%2Fsite.test/*.csv"))) for r in list(csv.reader(open(f, newline="")))[1:]]
    assert len(urls) == 408 and urls == sorted(urls)


def test_verdicts(spark):
    rows = [("a", "h", 0, 1, 0, 0, 0), ("b", "h", 0, 0, 1, 0, 0), ("c", "h", 1, 1, 0, 0, 1), ("d", "h", 3, 1, 0, 0, 3), ("e", "h", 20, 1, 0, 11, 20), ("f", "h", 20, 1, 2, 10, 20), ("g", "h", 5000, 1, 0, 0, 40)]
    out = scores.site_verdict(spark.createDataFrame(rows, "site string, host string, n_entries int, n_loaded int, n_failed int, deep_errors int, n_deep int"))
    got = [r.verdict.split(":")[0] for r in out.orderBy("site").collect()]
    assert got == ["Sitemap references were found, but no usable URL entries could be extracted.", "Not compatible yet", "Single-page sitemap detected", "Thin sitemap detected", "Partially compatible", "Mostly compatible", "Compatible"]
    assert "5,000" in out.where("site = 'g'").first().summary


def test_reports(audit):
    assert {r.url[8:] for r in reports.search_pages(audit.pages, audit.page_issues, q="identical").collect()} == {"site.test/dupe-a", "site.test/dupe-b"}
    assert reports.visible_count(reports.search_pages(audit.pages, audit.page_issues, issue="clean")).first().n == 0
    assert reports.recent_pages(audit.pages).where("site = 'https://site.test'").count() == 7
    assert reports.summary_rows(audit.report).count() == 4


def test_no_pages_and_counters(spark):
    sites = spark.createDataFrame([("x",)], "site string")
    pages = spark.createDataFrame([], "site string, url string, section string, page_type string, title string, description string, lastmod string")
    issues = spark.createDataFrame([], "site string, url string, severity string")
    assert tuple(scores.site_scores(sites, pages, issues, issues.drop("url")).first())[1:] == (70, 100, 90)
    assert tuple(run_counters(spark.createDataFrame([(3,), (None,)], "discovered_url_count long")).first()) == (2, 3)


def test_streamed_counters(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = "discovered_url_count long"
    spark.createDataFrame([(3,), (None,)], schema).write.parquet(log)
    query = stream_run_counters(spark.readStream.schema(schema).parquet(log), out, str(tmp_path / "checkpoint"))
    try:
        query.processAllAvailable()
        assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(2, 3)]
        spark.createDataFrame([(4,)], schema).write.mode("append").parquet(log)
        query.processAllAvailable()
        assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(3, 7)]
    finally:
        query.stop()


def test_depth_limit_is_told(spark):
    index = lambda child: f"<sitemapindex><sitemap><loc>https://e.com/{child}.xml</loc></sitemap></sitemapindex>"
    docs = spark.createDataFrame([(f"https://e.com/s{i}.xml", True, None, index(f"s{i + 1}")) for i in range(3)], "url string, ok boolean, error string, body string")
    seeds = spark.createDataFrame([("https://e.com", "https://e.com/s0.xml", 0)], "site string, sitemap_url string, pos int")
    with pytest.warns(UserWarning, match="^1 sitemap files lie deeper than 2 levels"):
        assert sitemaps.expand_sitemaps(seeds, docs, max_depth=2).count() == 2
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert sitemaps.expand_sitemaps(seeds, docs, max_depth=5).count() == 4
