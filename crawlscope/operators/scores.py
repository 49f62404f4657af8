"""Statistics, scores and verdicts of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_weight() -> Column:
    """Weight of a page in hundredths: integers, so that sums don't depend on their order."""
    t = F.col("page_type")
    return (
        F.when(t.isin("home", "static"), 100)
        .when(t.isin("category", "source"), 75)
        .when(t.isin("category_page", "archive", "canvas"), 35)
        .when(t.isin("cluster", "story", "generated"), 25)
        .otherwise(50)
    )


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(x))).cast("int")


def depth_penalty(n: Column) -> Column:
    return F.when(n == 1, 35).when(n.between(2, 4), 20).when(n < 10, 10).otherwise(0)


def _severities(issues: DataFrame, prefix: str = "") -> DataFrame:
    s = F.col("severity")
    return issues.groupBy("site").agg(*[F.count_if(s == name).alias(f"{prefix}{name}s") for name in ("error", "warning", "notice")])


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0))


def site_stats(sites: DataFrame, pages: DataFrame, page_issues: DataFrame, site_issues: DataFrame) -> DataFrame:
    """(site, pages, sections, errors, warnings, notices) over page and site issues.

    Every aggregation is partial before it is shuffled by site, so a huge site is no hot key.
    """
    counts = pages.groupBy("site").agg(F.count("*").alias("pages"), F.count_distinct("section").alias("sections"))
    issues = _severities(page_issues.select("site", "severity").unionByName(site_issues.select("site", "severity")))
    cols = ["pages", "sections", "errors", "warnings", "notices"]
    return sites.select("site").join(counts, "site", "left").join(issues, "site", "left").select("site", *[_zero(c).cast("long").alias(c) for c in cols])


def site_scores(sites: DataFrame, pages: DataFrame, page_issues: DataFrame, site_issues: DataFrame, profile: str = "full") -> DataFrame:
    """(site, index, seo, sitemap), each from 0 to 100.

    Full: missing titles, descriptions and lastmods count by page weight. Preview: unweighted; titles
    and descriptions, and page issues in ``seo``, over deep-checked pages only.
    """
    preview = profile == "preview"
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    deep = F.col("deep_checked") if preview else F.lit(True)
    w = F.lit(100) if preview else page_weight()
    facts = pages.groupBy("site").agg(
        F.count("*").alias("n"),
        F.count_distinct("section").alias("sections"),
        F.sum(w).alias("w_all"),
        F.sum(F.when(deep, w).otherwise(0)).alias("w_deep"),
        F.sum(F.when(deep & missing("title"), w).otherwise(0)).alias("w_title"),
        F.sum(F.when(deep & missing("description"), w).otherwise(0)).alias("w_desc"),
        F.sum(F.when(missing("lastmod"), w).otherwise(0)).alias("w_lastmod"),
    )
    if preview:
        page_issues = page_issues.join(pages.where("deep_checked").select("site", "url"), ["site", "url"], "left_semi")
    issues = _severities(page_issues.select("site", "severity").unionByName(site_issues.select("site", "severity")))
    own = site_issues.groupBy("site").agg(F.count_if(F.col("severity") == "error").alias("site_errors"))
    df = sites.select("site").join(facts, "site", "left").join(issues, "site", "left").join(own, "site", "left").na.fill(0)
    share = lambda part, whole, points: round_half_up(F.col(part) / F.greatest(F.col(whole), F.lit(100)) * points)
    depth = depth_penalty(F.col("n"))
    index = 100 - depth - share("w_title", "w_deep", 20)
    if not preview:
        index = index - 2 * F.greatest(F.lit(0), 10 - F.col("sections"))
    seo = F.lit(100.0) - F.col("errors") * F.lit(10.0) - F.col("warnings") * F.lit(1.25) - F.col("notices") * F.lit(0.15) - share("w_desc", "w_deep", 12)
    sitemap = 100 - depth - share("w_lastmod", "w_all", 10) - (F.lit(0) if preview else 15 * F.col("site_errors"))
    return df.select("site", clamp(index).alias("index"), clamp(seo).alias("seo"), clamp(sitemap).alias("sitemap"))


def site_verdict(facts: DataFrame) -> DataFrame:
    """(site, verdict, summary) of ``facts(site, host, n_entries, n_loaded, n_failed, deep_errors, n_deep)``."""
    n = F.col("n_entries")
    verdict = (
        F.when((n == 0) & (F.col("n_loaded") > 0), "Sitemap references were found, but no usable URL entries could be extracted.")
        .when(n == 0, "Not compatible yet: no accessible XML sitemap URLs were found.")
        .when(n == 1, "Single-page sitemap detected: metadata is available, but the sitemap only exposes one URL.")
        .when(n < 5, F.format_string("Thin sitemap detected: only %d URLs were indexed.", n))
        .when(F.col("deep_errors") > F.greatest(F.lit(10.0), n * F.lit(0.5)), "Partially compatible: sitemap URLs were indexed, but many sampled pages could not be fetched.")
        .when(F.col("n_failed") > 0, "Mostly compatible: some sitemap files failed, but usable URLs were indexed.")
        .otherwise("Compatible: sitemap URLs were indexed and sampled page metadata was accessible.")
    )
    summary = (
        F.when(n == 0, F.format_string("%s did not expose usable sitemap URLs to this run.", "host"))
        .when(n == 1, F.format_string("%s exposed only one sitemap URL. The page may be healthy, but the sitemap inventory is thin unless this is intentionally a one-page site.", "host"))
        .when(n < 5, F.format_string("%s exposed %d sitemap URLs. This shallow inventory should be compared against the real public pages.", "host", n))
        .otherwise(F.format_string("%s exposed %,d sitemap URLs. This preview sampled %,d pages for metadata and kept the rest as index-only rows.", "host", n, "n_deep"))
    )
    return facts.select("site", verdict.alias("verdict"), summary.alias("summary"))


def score_tone(score: Column) -> Column:
    return F.when(score >= 85, "good").when(score >= 65, "warn").otherwise("bad")
