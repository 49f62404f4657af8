"""Lastmods near a loc in one pass, and the preview's bounds in order of discovery."""

from __future__ import annotations

import random
import re
import time

import pytest

from crawlscope.operators import sitemaps
from crawlscope.plans.audit import PREVIEW, run_audit
from crawlscope.sources.fetch_log import SCHEMA

LASTMOD = re.compile(sitemaps.LASTMOD, re.A)


def near(body, loc):
    """What the window around the first place holds, by plain search."""
    at = body.find(loc)
    hit = LASTMOD.search(body[max(0, at - 600) : at + 1200]) if at >= 0 else None
    return hit[1] if hit else None


def test_lastmods_of_one_pass():
    rng = random.Random(4)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(60)):
            parts.append(rng.choice(["<loc>https://e.com/{}</loc>", "<url><loc> https://e.com/{}/x</loc>", "https://e.com/{}", "<a href=\"http://w.org/https://e.com/{}\">", "<lastmod>2024-{}</lastmod>", "<lastmod x='1'> 20{}\n</lastmod>", "<lastmod <lastmod>{}</lastmod>", "x" * rng.randrange(500), "é<LASTMOD>{}</LASTMOD>"]).format(rng.randrange(30)))
        body = "".join(parts)
        locs = [f"https://e.com/{i}" for i in range(31)] + ["https://e.com/", "http://w.org/https://e.com/3", "https://e.com/1/x"]
        assert sitemaps.lastmods_near(body, locs) == [near(body, u) for u in locs]


def test_lastmods_of_a_large_file():
    locs = [f"https://e.com/section/page-{i}" for i in range(50_000)]
    body = "".join(f"<url><loc>{u}</loc><lastmod>2024-{i}</lastmod></url>" for i, u in enumerate(locs))
    began = time.perf_counter()
    got = sitemaps.lastmods_near(body, locs)
    assert time.perf_counter() - began < 15 and len(got) == 50_000 and got[0] == "2024-0"


def loaded_in_order(seeds, bodies, max_files, max_urls):
    """(files visited, entries) of a site by a plain queue; a urlset that doesn't end is left to recovery."""
    queue, seen, entries = list(seeds), [], {}
    site = lambda u: u.startswith("https://e.com/")
    is_map = lambda u: "sitemap" in u or u.endswith(".xml")
    while queue and len(seen) < max_files and len(entries) < max_urls:
        f = queue.pop(0)
        if f in seen:
            continue
        seen.append(f)
        body = bodies.get(f)
        if body is None:
            continue
        locs = list(dict.fromkeys(re.findall(r"<loc>([^<]+)</loc>", body)))
        if "<sitemapindex" in body:
            queue += [u for u in re.findall(r"<sitemap><loc>([^<]+)</loc>", body) if is_map(u) and site(u) and u not in seen]
        for u, m in re.findall(r"<url><loc>([^<]+)</loc>(?:<lastmod>([^<]+)</lastmod>)?</url>", body) if "</urlset>" in body else []:
            if site(u) and not is_map(u):
                entries.setdefault(u, m or None)
            if len(entries) >= max_urls:
                break
        for u in locs:
            if not site(u):
                continue
            if is_map(u) and u not in seen:
                queue.append(u)
            elif not u.endswith(".xml") and not is_map(u):
                entries.setdefault(u, near(body, u))
            if len(entries) >= max_urls:
                break
    return seen, entries


def made_site(rng):
    bodies, page = {}, lambda: f"https://e.com/{rng.choice('zyxabc')}{rng.randrange(25)}"
    names = [f"https://e.com/sitemap-{i}.xml" for i in range(9)]
    for i, name in enumerate(names):
        kind = rng.randrange(4)
        if kind == 0 or i == 0:
            bodies[name] = "<sitemapindex>" + "".join(f"<sitemap><loc>{rng.choice(names)}</loc></sitemap>" for _ in range(4)) + "</sitemapindex>"
        elif kind < 3:
            urls = [page() if rng.random() < 0.9 else "https://o.org/x" for _ in range(rng.randrange(1, 9))]
            head = f"<!-- <loc>{page()}</loc> -->" if rng.random() < 0.5 else ""
            bodies[name] = head + "<urlset>" + "".join(f"<url><loc>{u}</loc>" + (f"<lastmod>2024-{rng.randrange(9)}</lastmod>" if rng.random() < 0.5 else "") + "</url>" for u in urls) + ("</urlset>" if kind == 1 else "")
    return names[:1] + names[3:5], bodies


@pytest.mark.parametrize("max_files,max_urls", [(35, 7), (4, 12)])
def test_bounds_in_order_of_discovery(spark, max_files, max_urls):
    rng = random.Random(max_files * 1000 + max_urls)
    seeds, docs, want_files, want_entries = [], [], set(), set()
    for k in range(40):
        start, bodies = made_site(rng)
        for u in start:
            seeds.append((f"https://e.com/{k}", u, start.index(u)))
        # Files of all sites share their names, so each site has a host of its own.
        own = lambda x, k=k: x.replace("e.com/", f"e{k:02}.com/")
        seen, entries = loaded_in_order(start, {u: b for u, b in bodies.items()}, max_files, max_urls)
        seeds[-len(start) :] = [(f"https://e{k:02}.com", own(u), i) for i, u in enumerate(start)]
        docs += [(own(u), True, None, own(b)) for u, b in bodies.items()]
        want_files |= {(f"https://e{k:02}.com", own(f)) for f in seen}
        want_entries |= {(f"https://e{k:02}.com", own(u), m) for u, m in entries.items()}
    docs = spark.createDataFrame(docs, "url string, ok boolean, error string, body string")
    files = sitemaps.expand_sitemaps(spark.createDataFrame(seeds, "site string, sitemap_url string, pos int"), docs, "preview", max_files=max_files, max_urls=max_urls)
    assert {(r.site, r.sitemap_url) for r in files.collect()} == want_files
    got = sitemaps.sitemap_entries(files, docs, "preview").collect()
    assert {(r.site, r.url, r.lastmod) for r in got} == want_entries and len(got) == len(want_entries)


def test_preview_stops_at_its_budget(spark):
    """A site beyond 1,200 URLs whose files list them in an order unlike the alphabet."""
    part = lambda k: f"https://e.com/sitemap-{k}.xml"
    names = [f"https://e.com/p{(i * 7919) % 3001:04}" for i in range(2000)]
    bodies = {part(k): "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in names[k * 500 : k * 500 + 500]) + "</urlset>" for k in range(4)}
    bodies["https://e.com/sitemap.xml"] = "<sitemapindex>" + "".join(f"<sitemap><loc>{part(k)}</loc></sitemap>" for k in range(4)) + "</sitemapindex>"
    cols = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    rows = [{"url": u, "status": 200, "body": b} for u, b in bodies.items()] + [{"url": "https://e.com/robots.txt", "status": 200, "body": "Sitemap: https://e.com/sitemap.xml"}]
    log = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], SCHEMA)
    audit = run_audit(spark.createDataFrame([("e.com",)], "site string"), log, PREVIEW)
    assert {r.url for r in audit.entries.collect()} == set(names[:1200])
    assert sorted(r.sitemap_url[-5:] for r in audit.files.collect()) == ["0.xml", "1.xml", "2.xml", "p.xml"]
    assert audit.site_issues.where("code = 'URL_INDEX_LIMIT_REACHED'").count() == 1
