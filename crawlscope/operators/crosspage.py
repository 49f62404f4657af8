"""Operators across the pages of a site: best-of dedupe and duplicate metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

#: Types whose duplicate title is only a notice.
MILD_TYPES = ("cluster", "archive", "category_page", "canvas", "generated")


def completeness() -> Column:
    have = lambda c: F.coalesce(F.col(c) != "", F.lit(False)).cast("int")
    return have("title") * 3 + have("description") * 2 + have("lastmod") + F.coalesce(F.col("status") == 200, F.lit(False)).cast("int") * 2


def page_key() -> Column:
    """Key under which pages are one: of the resolved canonical, else the final URL, else the URL."""
    target = F.coalesce(U.resolve_url(F.col("canonical"), F.col("url")), F.col("final_url"), F.col("url"))
    return F.coalesce(U.dedupe_key(target), U.dedupe_key(F.col("url")), F.col("url"))


def dedupe_pages(pages: DataFrame, collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The most complete page of each key, ties to the smaller URL by ``collation``, and (site, dropped) counts."""
    best = Window.partitionBy("site", "__key").orderBy(F.desc("__score"), *T.collated("url", collation))
    ranked = pages.withColumn("__key", page_key()).withColumn("__score", completeness()).withColumn("__n", F.row_number().over(best))
    kept = ranked.where("__n = 1").drop("__key", "__score", "__n")
    dropped = ranked.where("__n > 1").groupBy("site").agg(F.count("*").alias("dropped"))
    return kept, dropped


def _shared(pages: DataFrame, col: str) -> DataFrame:
    """(site, url, page_type) of the pages whose lower-cased ``col`` another page of the site has."""
    rows = pages.where(F.coalesce(F.col(col), F.lit("")) != "").select("site", "url", "page_type", F.lower(col).alias("value"))
    twice = rows.groupBy("site", "value").agg(F.count("*").alias("n")).where("n > 1").select("site", "value")
    return rows.join(twice, ["site", "value"], "left_semi")


def duplicate_titles(pages: DataFrame, profile: str = "full") -> DataFrame:
    """Page issues (site, url, severity, code, message) of titles that occur more than once.

    Values are counted first and joined back as a set, so a title that millions of pages share costs
    one row and no window over them.
    """
    mild = F.lit("warning") if profile == "preview" else F.when(F.col("page_type").isin(*MILD_TYPES), "notice").otherwise("warning")
    return _shared(pages, "title").select("site", "url", mild.alias("severity"), F.lit("DUPLICATE_TITLE").alias("code"), F.lit("Title is duplicated on another indexed page.").alias("message"))


def duplicate_descriptions(pages: DataFrame) -> DataFrame:
    """As :func:`duplicate_titles`, for descriptions; always a notice."""
    return _shared(pages, "description").select("site", "url", F.lit("notice").alias("severity"), F.lit("DUPLICATE_META_DESCRIPTION").alias("code"), F.lit("Meta description is duplicated on another indexed page.").alias("message"))


def merge_issues(*stages: DataFrame) -> DataFrame:
    """(site, url, stage, ord, severity, code, message) of issue frames in order of emission."""
    out = [s.select("site", "url", F.lit(i).alias("stage"), F.col("ord") if "ord" in s.columns else F.lit(0).alias("ord"), "severity", "code", "message") for i, s in enumerate(stages)]
    return reduce(DataFrame.unionByName, out)
