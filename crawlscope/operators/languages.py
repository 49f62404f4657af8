"""Optional checks of language versions, OpenGraph and schema.org presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import head
from ..functions import urls as U

#: A language, script and region as hreflang takes them, or the default version.
_CODE = r"\A(x-default|[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?)\z"


def head_extras(pages: DataFrame, body: str = "body") -> DataFrame:
    """``pages`` with alternates, open_graph and schema_types of their HTML, and without the HTML; null HTML has none."""
    html = F.coalesce(F.col(body), F.lit(""))
    shown = head.visible(html)
    return pages.withColumns({"alternates": head.alternates(shown), "open_graph": head.open_graph(shown), "schema_types": head.schema_types(html)}).drop(body)


def alternate_links(pages: DataFrame) -> DataFrame:
    """(url, lang, target) of ``pages(url, alternates)``, both URLs in normal form, each link once; what is no URL is left out."""
    links = pages.select("url", F.explode("alternates").alias("a"))
    return (
        links.select(U.norm_url(F.col("url")).alias("url"), F.col("a.lang").alias("lang"), U.norm_url(U.resolve_url(F.col("a.href"), F.col("url"))).alias("target"))
        .where("url IS NOT NULL AND target IS NOT NULL")
        .distinct()
    )


def alternate_problems(pages: DataFrame) -> DataFrame:
    """(url, lang, target, problem) of the alternate links of ``pages(url, alternates)`` that a search engine ignores.

    ``bad code``: no language code. ``not audited``: the target is none of the pages. ``no return``:
    the target has no alternate link back. A link gets the first that holds; one to its own page
    needs no return. Pages that many others link to are met by (page, target) pairs, so they are no
    hot key.
    """
    links = alternate_links(pages)
    back = links.select(F.col("target").alias("url"), F.col("url").alias("target"), F.lit(True).alias("returned")).distinct()
    known = pages.select(U.norm_url(F.col("url")).alias("target"), F.lit(True).alias("known")).distinct()
    told = links.join(back, ["url", "target"], "left").join(known, "target", "left")
    problem = (
        F.when(~F.col("lang").rlike(_CODE), "bad code")
        .when(F.col("url") == F.col("target"), F.lit(None))
        .when(F.col("known").isNull(), "not audited")
        .when(F.col("returned").isNull(), "no return")
    )
    return told.withColumn("problem", problem).where("problem IS NOT NULL").select("url", "lang", "target", "problem")
