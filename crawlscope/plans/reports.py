"""Report queries over the pages and issues of audits; all sites at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RECENT, SECTIONS, CODES, BADGES, FINDINGS, ROWS = 8, 10, 25, 4, 5, 300


def search_pages(pages: DataFrame, issues: DataFrame, q: str = "", section: str = "", page_type: str = "", issue: str = "") -> DataFrame:
    """Pages whose text contains ``q``, of a section and type, with an issue of a severity or ``clean``."""
    cols = ("title", "url", "path", "display_path", "section", "page_type", "description")
    out = pages
    needle = q.strip().lower()
    if needle:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *[T.empty_to_null(F.col(c)) for c in cols])), F.lit(needle)))
    if section:
        out = out.where(F.col("section") == section)
    if page_type:
        out = out.where(F.col("page_type") == page_type)
    if issue:
        hit = issues.where(F.lit(True) if issue == "clean" else F.col("severity") == issue).select("site", "url")
        out = out.join(hit, ["site", "url"], "left_anti" if issue == "clean" else "left_semi")
    return out


def visible_count(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n"))


def section_facet(pages: DataFrame) -> DataFrame:
    return pages.select("site", "section").distinct().orderBy("site", "section")


def type_facet(pages: DataFrame) -> DataFrame:
    """(site, page_type, label); pages without a type are ``unknown``."""
    t = F.coalesce("page_type", F.lit("unknown"))
    return pages.select("site", t.alias("page_type")).distinct().withColumn("label", T.humanize(F.col("page_type"))).orderBy("site", "page_type")


def recent_pages(pages: DataFrame, k: int = RECENT) -> DataFrame:
    """The ``k`` pages of each site with the latest lastmod text, one for each target; ties by URL."""
    key = F.coalesce("canonical", "final_url", "url")
    newest = [F.desc("lastmod"), F.asc("url")]
    one = Window.partitionBy("site", "__key").orderBy(*newest)
    top = Window.partitionBy("site").orderBy(*newest)
    return (
        pages.where(F.coalesce("lastmod", F.lit("")) != "")
        .withColumn("__key", key)
        .withColumn("__n", F.row_number().over(one))
        .where("__n = 1")
        .withColumn("rank", F.row_number().over(top))
        .where(F.col("rank") <= k)
        .select("site", "rank", "url", F.coalesce("title", "display_path", "path").alias("label"), "lastmod", "display_path", T.humanize(F.coalesce("page_type", F.lit("unknown"))).alias("type_label"))
    )


def top_sections(pages: DataFrame, k: int = SECTIONS) -> DataFrame:
    """(site, rank, section, n): the largest sections of each site; ties by their first URL."""
    best = Window.partitionBy("site").orderBy(F.desc("n"), "first_url")
    counts = pages.groupBy("site", "section").agg(F.count("*").alias("n"), F.min("url").alias("first_url"))
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("site", "rank", "section", "n")


def issue_counts(issues: DataFrame, k: int = CODES, by_site: bool = True) -> DataFrame:
    """(site, code, n): the commonest issue codes of each site, or of all; ties by code."""
    keys = ["site"] if by_site else []
    counts = issues.groupBy(*keys, "code").agg(F.count("*").alias("n"))
    if not by_site:
        return counts.orderBy(F.desc("n"), "code").limit(k)
    best = Window.partitionBy("site").orderBy(F.desc("n"), "code")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def issue_lists(issues: DataFrame) -> DataFrame:
    """(site, url, issues): a page's issues in order of emission."""
    row = F.struct("stage", "ord", "severity", "code", "message")
    return issues.groupBy("site", "url").agg(F.array_sort(F.collect_list(row)).alias("issues"))


def _with_issues(pages: DataFrame, issues: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<stage:int,ord:int,severity:string,code:string,message:string>>")
    return pages.join(issue_lists(issues), ["site", "url"], "left").withColumn("issues", F.coalesce("issues", none))


def issue_badges(pages: DataFrame, issues: DataFrame, k: int = BADGES) -> DataFrame:
    """(site, url, badges): the first ``k`` labels, then ``+n`` for the rest; ``clean`` without any."""
    label = lambda i: T.humanize(i["code"])
    n = F.size("issues")
    shown = F.transform(F.slice("issues", 1, k), label)
    badges = F.when(n == 0, F.array(F.lit("clean"))).when(n > k, F.concat(shown, F.array(F.concat(F.lit("+"), (n - k).cast("string"))))).otherwise(shown)
    return _with_issues(pages.select("site", "url"), issues).select("site", "url", badges.alias("badges"))


def findings(pages: DataFrame, issues: DataFrame, k: int = FINDINGS) -> DataFrame:
    """Inventory rows of the preview: (site, url, label, page_type, mode, status, n_issues, findings)."""
    text = F.array_join(F.transform(F.slice("issues", 1, k), lambda i: T.humanize(i["code"])), ", ")
    return _with_issues(pages, issues).select(
        "site",
        "url",
        F.coalesce(T.empty_to_null(F.col("title")), F.col("path")).alias("label"),
        "page_type",
        F.when(F.col("deep_checked"), "Deep checked").otherwise("Index only").alias("mode"),
        "status",
        F.size("issues").alias("n_issues"),
        F.when(text == "", "Clean").otherwise(text).alias("findings"),
    )


def inventory_page(pages: DataFrame, k: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The first ``k`` pages of each site by URL with ``rank``, and (site, hidden) counts of the rest."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy("url"))
    shown = pages.withColumn("rank", rank).where(F.col("rank") <= k)
    hidden = pages.groupBy("site").agg(F.greatest(F.lit(0), F.count("*") - k).alias("hidden"))
    return shown, hidden


def summary_rows(report: DataFrame) -> DataFrame:
    """One line per run: site, statistics and scores."""
    return report.select("site", "pages", "sections", "errors", "warnings", "notices", "index", "seo", "sitemap")


def compare_crawls(before: DataFrame, after: DataFrame) -> DataFrame:
    """(site, url, change) between two page snapshots: added, removed, changed or same."""
    seen = ["title", "description", "canonical", "status", "lastmod"]
    state = lambda df, c: df.select("site", "url", F.struct(*seen).alias(c))
    both = state(before, "old").join(state(after, "new"), ["site", "url"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return both.select("site", "url", change.alias("change"))


def type_breakdown(pages: DataFrame) -> DataFrame:
    return pages.groupBy("site", F.coalesce("page_type", F.lit("unknown")).alias("page_type")).agg(F.count("*").alias("n"))


def priority_list(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(site, url, n_errors, n_warnings, n_notices) of the pages with issues."""
    s: Column = F.col("severity")
    return issues.join(pages.select("site", "url"), ["site", "url"], "left_semi").groupBy("site", "url").agg(*[F.count_if(s == x).alias(f"n_{x}s") for x in ("error", "warning", "notice")])
