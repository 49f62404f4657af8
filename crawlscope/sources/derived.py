"""Inputs of the audit derived from the driver's tables; one SQL text for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRAWL = """
SELECT page_id, CASE WHEN page_id % 13 = 6 THEN concat(regexp_extract(url,'^(https?://[^/?#]+)',1),'/p',CAST(page_id AS string)) ELSE regexp_extract(url,'^([^#]*)',1) END AS url, regexp_extract(url,'^https?://([^/?#]+)',1) AS site,
 CASE WHEN page_id % 7 = 0 THEN NULL ELSE concat('2024-',lpad(CAST(1 + page_id % 12 AS string),2,'0'),'-',lpad(CAST(1 + page_id % 28 AS string),2,'0')) END AS lastmod,
 CASE WHEN page_id % 50 = 13 THEN 404 WHEN page_id % 50 = 29 THEN NULL WHEN page_id % 50 = 41 THEN 304 ELSE 200 END AS status,
 replace(CASE WHEN page_id % 19 = 5 THEN regexp_replace(html,'<title>[^<]*</title>','') WHEN page_id % 19 = 7 THEN regexp_replace(html,'<title>[^<]*</title>',concat('<title>',repeat('Long title words ',6),'</title>')) ELSE html END,'</head>',concat(
  CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 10 = 3 THEN '<meta name="description" content="One summary that several pages of a site have in common, word for word.">' ELSE concat('<meta name="description" content="',substr(repeat(concat('Page ',CAST(page_id % 40 AS string),' summary text '),12),1,CAST(20 + (page_id * 13) % 220 AS int)),'">') END,
  CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 11 = 1 THEN '<link rel="canonical" href="https://other.example.org/x">' WHEN page_id % 11 = 2 THEN '<link rel="canonical" href="/en/shared">' ELSE concat('<link rel="canonical" href="',regexp_extract(url,'^([^#]*)',1),'">') END,
  CASE WHEN page_id % 17 = 0 THEN '<meta name="robots" content="noindex, follow">' ELSE '' END,
  '</head>')) AS html FROM {pages}
"""

FETCH_LOG = """
SELECT url, CASE WHEN page_id % 9 IN (4,5) OR page_id % 27 = 8 THEN 301 ELSE status END AS status,
 CASE WHEN page_id % 9 IN (4,5) OR page_id % 27 = 8 THEN concat(url,'-m1') END AS location,
 CASE WHEN page_id % 9 IN (4,5) OR page_id % 27 = 8 THEN NULL ELSE html END AS body FROM {crawl}
UNION ALL SELECT concat(url,'-m1'), CASE WHEN page_id % 9 = 4 THEN 200 ELSE 301 END,
 CASE WHEN page_id % 9 = 5 THEN concat(url,'-m2') WHEN page_id % 27 = 8 THEN url END,
 CASE WHEN page_id % 9 = 4 THEN html END FROM {crawl} WHERE page_id % 9 IN (4,5) OR page_id % 27 = 8
UNION ALL SELECT concat(url,'-m2'), 200, NULL, html FROM {crawl} WHERE page_id % 9 = 5
"""

#: One row for each URL.
ONCE = """
SELECT page_id, url, site, lastmod, status, html FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY page_id) AS n FROM {crawl}) x WHERE n = 1
"""

#: Pages whose redirects go on beyond every limit.
LONG_CHAINS = """
SELECT CASE WHEN i = 0 THEN url ELSE concat(url,'-h',CAST(i AS string)) END AS url, 301 AS status, concat(url,'-h',CAST(i + 1 AS string)) AS location, CAST(NULL AS string) AS body
FROM {once} JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11 UNION ALL SELECT 12) t ON page_id % 27 = 17
"""

#: Robots files of which some state no sitemap.
SITE_ROBOTS = """
SELECT site, concat('User-agent: *',chr(10),'Disallow: /en/9',chr(10),'Allow: /en/9*.html$',chr(10),'Disallow: /*?utm_source=',chr(10),CASE WHEN length(site) % 12 = 7 THEN '' ELSE concat('Sitemap: https://',site,'/sitemap.xml',chr(10)) END) AS body
FROM (SELECT DISTINCT site FROM {once}) x
"""

#: Sitemaps of four kinds by the length of a site's name: an index of three parts and a missing file (10 modulo
#: 12), none (9), one of foreign URLs alone (2, 3) and a plain one, truncated where 4 divides the length.
SITE_MAPS = """
SELECT site, part, concat('https://',site,CASE WHEN part < 0 THEN '/sitemap.xml' ELSE concat('/sitemap-',CAST(part AS string),'.xml') END) AS sitemap_url,
 concat('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', {agg}, CASE WHEN length(site) % 4 = 0 THEN '' ELSE '</urlset>' END) AS body
FROM (SELECT site, page_id, CASE WHEN length(site) % 12 = 10 THEN page_id % 3 ELSE -1 END AS part,
 concat('<url><loc>',CASE WHEN length(site) % 12 IN (2,3) THEN concat('https://elsewhere.example/',CAST(page_id AS string)) ELSE replace(url,'&','&amp;') END,'</loc>',CASE WHEN lastmod IS NULL THEN '' ELSE concat('<lastmod>',lastmod,'</lastmod>') END,'</url>') AS u
 FROM {once} WHERE length(site) % 12 <> 9) x GROUP BY site, part
UNION ALL SELECT DISTINCT site, CAST(-1 AS BIGINT), concat('https://',site,'/sitemap.xml'), concat('<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://',site,'/sitemap-0.xml</loc></sitemap><sitemap><loc>https://',site,'/sitemap-1.xml</loc></sitemap><sitemap><loc>https://',site,'/sitemap-2.xml</loc></sitemap><sitemap><loc>https://',site,'/sitemap-gone.xml</loc></sitemap></sitemapindex>')
FROM {once} WHERE length(site) % 12 = 10
"""

ROBOTS_TXT = """
SELECT site, concat('# robots for ',site,chr(10),'User-agent: otherbot',chr(10),'Disallow: /',chr(10),chr(10),'User-agent: *',chr(10),'Disallow: /en/9',chr(10),'Allow: /en/9*.html$',chr(10),'Disallow: /*?utm_source=',chr(10),'Disallow:',chr(10),'Crawl-delay: 5',chr(10),'Sitemap: https://',site,'/sitemap.xml',chr(10),'Sitemap: https://',site,'/llms.txt',chr(10)) AS body
FROM (SELECT DISTINCT site FROM {crawl}) x
"""

SITEMAP_XML = """
SELECT site, concat('https://',site,'/sitemap.xml') AS sitemap_url,
 concat('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', {agg}, CASE WHEN length(site) % 4 = 0 THEN '' ELSE '</urlset>' END) AS body
FROM (SELECT site, page_id, concat('<url><loc>',replace(url,'&','&amp;'),'</loc>',CASE WHEN lastmod IS NULL THEN '' ELSE concat('<lastmod>',lastmod,'</lastmod>') END,'</url>') AS u FROM {crawl}) x GROUP BY site
"""

INVENTORY = """
SELECT DISTINCT concat('s',CAST(l_suppkey AS string),'.example.com') AS site,
 concat('https://s',CAST(l_suppkey AS string),'.example.com/',CASE l_returnflag WHEN 'A' THEN 'archive' WHEN 'R' THEN 'tag' ELSE 'docs' END,'/',CAST(l_partkey AS string)) AS url,
 substr(CAST(l_shipdate AS string),1,10) AS lastmod FROM {lineitem}
"""


#: Robots files that rule on a third of an inventory's paths, one by one.
STOCK_RULES = """
SELECT DISTINCT site, path, k, CASE WHEN k % 6 = 0 THEN concat('Allow: ',path,'$') WHEN k % 12 = 3 THEN concat('Disallow: ',path,'*9') ELSE concat('Disallow: ',path) END AS line
FROM (SELECT site, CAST(regexp_extract(url,'([0-9]+)$',1) AS BIGINT) AS k, regexp_extract(url,'^https?://[^/]+(.*)$',1) AS path FROM {inventory}) x WHERE k % 3 = 0
"""

STOCK_ROBOTS = """
SELECT site, concat('User-agent: *',chr(10),'Disallow: /*5$',chr(10),'Disallow: /archive/1',chr(10), {agg}) AS body FROM {rules} GROUP BY site
"""

#: Pages with what they should be read as: other titles in comments, scripts and styles, attributes in any order and
#: quotes, and entities.
HIDDEN_HEADS = """
SELECT page_id, status, concat('<html><head>',
  CASE page_id % 4 WHEN 0 THEN '<!-- <title>Not this</title> <meta name="description" content="nor this"> -->' WHEN 1 THEN '<script type="a>b">document.write("<title>Not this</title><!--")</script>' WHEN 2 THEN '<STYLE>/* <title>Not this</title> */</STYLE ><textarea><link rel="canonical" href="/not"></textarea>' ELSE '' END,
  '<title data-x="1>0">  Page',chr(10),CAST(page_id AS string),' &eacute;&#8211;&#x1F600; &lt;b&gt; &amp;amp; &copy 1 &nosuch; &#150;',CASE WHEN page_id % 3 = 0 THEN ' <!-- kept -->' ELSE '' END,'</title>',
  CASE WHEN page_id % 5 = 0 THEN '<META CONTENT=word NAME=description>' ELSE '<meta property="name=description" content="other"><meta content="It&rsquo;s > ' END,CASE WHEN page_id % 5 = 0 THEN '' ELSE concat(CAST(page_id AS string),'" name=''description''/>') END,
  '<link href="/a?x=1&amp;y=',CAST(page_id AS string),'" REL=Canonical>',CASE WHEN page_id % 6 = 0 THEN '<meta name=robots content=NoIndex,follow>' ELSE '' END,
  '</head><body><svg><title>Not this</title></svg></body></html>') AS html FROM {crawl}
"""

#: Each site's inventory in ten sitemap files, some URLs in two of them, in an order unlike the alphabet: an index lists
#: the first five and another index, which lists the others.
STOCK_LISTED = """
SELECT site, url, lastmod, part, CAST(regexp_extract(url,'([0-9]+)$',1) AS BIGINT) AS k FROM (
 SELECT site, url, min(lastmod) AS lastmod, CAST(regexp_extract(url,'([0-9]+)$',1) AS BIGINT) % 10 AS part FROM {inventory} GROUP BY site, url
 UNION ALL SELECT site, url, max(lastmod), (CAST(regexp_extract(url,'([0-9]+)$',1) AS BIGINT) + 3) % 10 FROM {inventory} WHERE CAST(regexp_extract(url,'([0-9]+)$',1) AS BIGINT) % 7 = 0 GROUP BY site, url) x
"""

STOCK_MAPS = """
SELECT concat('https://',site,'/sitemap-',CAST(part AS string),'.xml') AS url, concat('<urlset>', {agg}, '</urlset>') AS body
FROM (SELECT site, part, k, url, concat('<url><loc>',url,'</loc><lastmod>',lastmod,'</lastmod></url>') AS u FROM {listed}) x GROUP BY site, part
UNION ALL SELECT concat('https://',site,CASE WHEN deep = 1 THEN '/sitemap-deep.xml' ELSE '/sitemap.xml' END), concat('<sitemapindex>',
 CASE WHEN deep = 1 THEN '' ELSE concat('<sitemap><loc>https://',site,'/sitemap-4.xml</loc></sitemap><sitemap><loc>https://',site,'/sitemap-0.xml</loc></sitemap>') END,
 CASE WHEN deep = 1 THEN concat('<sitemap><loc>https://',site,'/sitemap-9.xml</loc></sitemap><sitemap><loc>https://',site,'/sitemap-5.xml</loc></sitemap><sitemap><loc>https://',site,'/sitemap-0.xml</loc></sitemap><sitemap><loc>https://',site,'/sitemap-7.xml</loc></sitemap>')
 ELSE concat('<sitemap><loc>https://',site,'/sitemap-deep.xml</loc></sitemap><sitemap><loc>https://',site,'/sitemap-2.xml</loc></sitemap><sitemap><loc>https://',site,'/sitemap-1.xml</loc></sitemap>') END, '</sitemapindex>')
FROM (SELECT DISTINCT site FROM {listed}) s CROSS JOIN (SELECT 0 AS deep UNION ALL SELECT 1) t
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with status, lastmod, description, canonical and noindex derived from page_id."""
    return spark.sql(CRAWL, pages=read(spark, sf_dir, "pages"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch log in which some pages redirect once, twice or in a loop."""
    return spark.sql(FETCH_LOG, crawl=crawl(spark, sf_dir))


def robots_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ROBOTS_TXT, crawl=crawl(spark, sf_dir))


def sitemap_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = SITEMAP_XML.replace("{agg}", "listagg(u, '') WITHIN GROUP (ORDER BY page_id)")
    return spark.sql(text, crawl=crawl(spark, sf_dir))


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ONCE, crawl=crawl(spark, sf_dir))


def site_maps(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Sitemaps of whole audits: (site, part, sitemap_url, body) of the ``pages`` of :func:`once`."""
    return spark.sql(SITE_MAPS.replace("{agg}", "listagg(u, '') WITHIN GROUP (ORDER BY page_id)"), once=pages)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL inventory of the size of lineitem, without HTML."""
    return spark.sql(INVENTORY, lineitem=read(spark, sf_dir, "lineitem"))


def stock_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(STOCK_RULES, inventory=inventory(spark, sf_dir))
    return spark.sql(STOCK_ROBOTS.replace("{agg}", "listagg(line, chr(10)) WITHIN GROUP (ORDER BY path)"), rules=rules)


def hidden_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HIDDEN_HEADS, crawl=crawl(spark, sf_dir))


def stock_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followed sitemap documents (url, ok, error, body) of the inventory's sites."""
    listed = spark.sql(STOCK_LISTED, inventory=inventory(spark, sf_dir))
    maps = spark.sql(STOCK_MAPS.replace("{agg}", "listagg(u, '') WITHIN GROUP (ORDER BY k DESC, url)"), listed=listed)
    return maps.selectExpr("url", "true AS ok", "CAST(NULL AS string) AS error", "body")


def site_log(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """One fetch log with pages, robots files and sitemaps, for whole audits; of ``pages``, if :func:`once` is written."""
    pages = once(spark, sf_dir) if pages is None else pages
    log = spark.sql(FETCH_LOG, crawl=pages)
    long = spark.sql(LONG_CHAINS, once=pages)
    log = log.join(long.select("url"), "url", "left_anti").select(*long.columns).unionByName(long)
    robots = spark.sql(SITE_ROBOTS, once=pages).selectExpr("concat('https://', site, '/robots.txt') AS url", "200 AS status", "CAST(NULL AS string) AS location", "body")
    maps = site_maps(spark, pages).selectExpr("sitemap_url AS url", "200 AS status", "CAST(NULL AS string) AS location", "body")
    return log.unionByName(robots).unionByName(maps)


def oracle_ctes() -> str:
    """The derived tables as common table expressions of DuckDB."""
    agg = "string_agg(u, '' ORDER BY page_id)"
    return ", ".join(
        f"{name} AS ({sql})"
        for name, sql in (
            ("crawl", CRAWL.format(pages="pages")),
            ("fetch_log", FETCH_LOG.format(crawl="crawl")),
            ("robots_txt", ROBOTS_TXT.format(crawl="crawl")),
            ("sitemap_xml", SITEMAP_XML.format(crawl="crawl", agg=agg)),
            ("inventory", INVENTORY.format(lineitem="lineitem")),
            ("stock_rules", STOCK_RULES.format(inventory="inventory")),
            ("stock_listed", STOCK_LISTED.format(inventory="inventory")),
            ("once", ONCE.format(crawl="crawl")),
            ("long_chains", LONG_CHAINS.format(once="once")),
            ("site_maps", SITE_MAPS.format(once="once", agg=agg)),
            ("once_log", FETCH_LOG.format(crawl="once")),
            ("site_pages", "SELECT url, status, location, body FROM once_log WHERE url NOT IN (SELECT url FROM long_chains) UNION ALL SELECT * FROM long_chains"),
        )
    )


def language_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, body) of the pages as three language versions of each story.

    A head links to all versions, some only to two, some by a code that is none; a seventh states none.
    """
    p = F.col("page_id")
    story, langs = F.floor(p / 3).cast("long"), F.array(F.lit("en"), F.lit("fr"), F.lit("pt-BR"))
    url = lambda lang: F.concat(F.lit("https://stories.example/"), story.cast("string"), F.lit("/"), F.lower(lang))
    link = lambda lang: F.concat(F.lit("<link hreflang='"), F.when((p % 11 == 0) & (lang == "fr"), "french").otherwise(lang), F.lit("' rel=alternate href=\""), url(lang), F.lit("/\">"))
    links = F.when(p % 7 == 0, "").otherwise(F.array_join(F.transform(F.slice(langs, F.lit(1), F.when(p % 5 == 0, 2).otherwise(3)), link), ""))
    types = F.when(p % 4 == 0, '{"@type": "Article"}').when(p % 4 == 1, '[{"@type": ["Thing", "Person"]}, {"@type": "Article"}]').when(p % 4 == 2, '{"@graph": [{"@type": "WebPage"}, 3]}').otherwise("{broken")
    graph = F.when(p % 2 == 0, '<meta property="og:title" content="t"><meta content="u" property="OG:url">').otherwise('<meta property="og:title" content=" ">')
    body = F.concat(F.lit("<html><head><!-- <link rel=alternate hreflang=xx href=/x> -->"), links, graph, F.lit('<script type="application/ld+json">'), types, F.lit("</script></head>"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", url(F.get(langs, (p % 3).cast("int"))).alias("url"), body.alias("body"))
