"""Sinks: the pages CSV and the nested index JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.reports import issue_lists

#: Columns of the pages CSV, in order.
CSV_COLUMNS = ("url", "path", "display_path", "section", "page_type", "title", "description", "canonical", "final_url", "lastmod", "status", "redirects", "issue_count", "issues")


#: Type of a page's or site's issues in the index.
BRIEFS = "array<struct<severity:string,code:string,message:string>>"


def csv_rows(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows of the pages CSV as strings, with ``site``: nulls are empty, issues ``severity:CODE|...``."""
    listed = pages.join(issue_lists(issues), ["site", "url"], "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return listed.select(
        "site",
        *[text(c).alias(c) for c in CSV_COLUMNS[:11]],
        F.coalesce("redirects", F.lit(0)).cast("string").alias("redirects"),
        F.coalesce(F.size("issues"), F.lit(0)).cast("string").alias("issue_count"),
        F.coalesce(F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["severity"], i["code"])), "|"), F.lit("")).alias("issues"),
    )


def write_pages_csv(pages: DataFrame, issues: DataFrame, path: str, by_site: bool = True) -> None:
    """The pages CSV with a header, sorted by URL within files, under ``site=`` folders or together.

    Files are ranges of (site, url), so that a large site is written by many tasks; its files in
    order of their names are in order of URLs.

    A value is quoted only if it holds a comma, quote or line break, and inner quotes are doubled.
    """
    rows = csv_rows(pages, issues).select("site", *CSV_COLUMNS)
    rows = _in_ranges(rows) if by_site else rows.drop("site").orderBy("url")
    out = rows.write.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "")
    out = out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (out.partitionBy("site") if by_site else out).csv(path)


def _in_ranges(rows: DataFrame, parts: int | None = None) -> DataFrame:
    dealt = rows.repartitionByRange("site", "url") if parts is None else rows.repartitionByRange(parts, "site", "url")
    return dealt.sortWithinPartitions("site", "url")


def _brief(i: Column) -> Column:
    return F.struct(i["severity"].alias("severity"), i["code"].alias("code"), i["message"].alias("message"))


def _listed_pages(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Pages as the index has them: ``site``, ``url``, their other columns and their issues."""
    kept = [c for c in pages.columns if c not in ("site", "url", "deep_checked")]
    briefs = F.coalesce(F.transform("issues", _brief), F.array().cast(BRIEFS)).alias("issues")
    return pages.join(issue_lists(issues), ["site", "url"], "left").select("site", "url", *kept, briefs)


def _index_head(report: DataFrame, site_issues: DataFrame) -> DataFrame:
    """A site's index without its pages. The preview's source also says what was tried and what went wrong."""
    root = site_issues.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", "severity", "code", "message"))).alias("root"))
    source = ["robots_url", "sitemap_urls", "from_robots"]
    if "tested_urls" in report.columns:
        source += ["input_mode", "tested_urls", "failures", F.col("verdict").alias("compatibility"), F.col("n_entries").alias("discovered_url_count"), F.col("n_deep").alias("deep_checked_count")]
    return report.join(root, "site", "left").select(
        "site",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generated_at"),
        F.struct(*source).alias("source"),
        F.struct("index", "seo", "sitemap").alias("scores"),
        F.struct("pages", "sections", "errors", "warnings", "notices").alias("stats"),
        F.coalesce(F.transform("root", _brief), F.array().cast(BRIEFS)).alias("issues"),
    )


def audit_result(report: DataFrame, pages: DataFrame, issues: DataFrame, site_issues: DataFrame) -> DataFrame:
    """One nested row per site: site, generated_at, source, scores, stats, pages[], issues[].

    All pages of a site are in one row; for sites too large for that see :func:`write_index_parts`.
    """
    listed = _listed_pages(pages, issues)
    nested = listed.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(*[c for c in listed.columns if c != "site"]))).alias("pages"))
    return _index_head(report, site_issues).join(nested, "site", "left").select("site", "generated_at", "source", "scores", "stats", "pages", "issues")


def index_documents(result: DataFrame) -> DataFrame:
    """(site, value): each row of ``result`` as an indented JSON document; absent values are left out."""
    return result.select("site", F.to_json(F.struct(*result.columns), {"pretty": "true"}).alias("value"))


def write_index_json(result: DataFrame, path: str) -> None:
    """One JSON document per site (:func:`index_documents`), under ``site=`` folders."""
    index_documents(result).write.partitionBy("site").text(path)


def write_index_parts(report: DataFrame, pages: DataFrame, issues: DataFrame, site_issues: DataFrame, path: str, parts: int | None = None) -> None:
    """The index of sites of any size: their pages in parts, and a manifest that puts them together.

    ``pages/site=/part=`` folders hold JSON lines of pages, which are ranges of (site, url) in
    ``parts`` tasks (by default as many as Spark finds fit). ``manifest/site=`` holds one JSON
    document per site: the index without pages, and ``page_parts`` (part, pages, first_url, last_url)
    in order of URLs. Read in that order the parts are the index's pages.
    """
    _in_ranges(_listed_pages(pages, issues), parts).withColumn("part", F.spark_partition_id()).write.partitionBy("site", "part").json(f"{path}/pages")
    written = report.sparkSession.read.schema("url string, part int, site string").json(f"{path}/pages")
    spans = written.groupBy("site", "part").agg(F.count("*").alias("pages"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))
    listed = spans.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("part", "pages", "first_url", "last_url"))).alias("page_parts"))
    none = F.array().cast("array<struct<part:int,pages:bigint,first_url:string,last_url:string>>")
    write_index_json(_index_head(report, site_issues).join(listed, "site", "left").withColumn("page_parts", F.coalesce("page_parts", none)), f"{path}/manifest")
