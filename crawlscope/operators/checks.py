"""Page metadata and the checks on each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import head
from ..functions import text as T
from ..functions import urls as U

#: Types whose missing or long metadata is only a notice.
GENERATED = ("archive", "cluster", "category_page", "canvas", "story", "generated")
#: Words of challenge pages, looked for in the first 1200 characters.
BLOCKED = r"(?i)cloudflare|access denied|captcha|bot detection|verify you are human|akamai|perimeterx|blocked|forbidden"
#: Pages of a site that the preview profile checks in full.
MAX_DEEP = 40

ISSUE = "struct<ord:int,severity:string,code:string,message:string>"


def _meta(html: Column, name: str) -> Column:
    one = T.first_match(html, rf"(?i)<meta[^>]+name=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)[\"'][^>]*>")
    two = T.first_match(html, rf"(?i)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+name=[\"']{name}[\"'][^>]*>")
    return F.coalesce(one, two)


def _canonical(html: Column) -> Column:
    one = T.first_match(html, r"(?i)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']*)[\"'][^>]*>")
    two = T.first_match(html, r"(?i)<link[^>]+href=[\"']([^\"']*)[\"'][^>]+rel=[\"']canonical[\"'][^>]*>")
    return F.coalesce(one, two)


def extract_metadata(df: DataFrame, body: str = "body", profile: str = "full") -> DataFrame:
    """``df`` with title, description, canonical and noindex of its HTML, and without the HTML.

    The full profile takes them as the document's tree has them: not from comments, scripts or
    styles, whatever the order and quotes of attributes, with all entities. The preview searches the
    text. Whatever reads the result no longer carries the body through a shuffle.
    """
    html = T.empty_to_null(F.col(body))
    if profile == "preview":
        title, meta, canonical = T.clean_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), lambda n: T.clean_html(_meta(html, n)), T.clean_html(_canonical(html))
    else:
        shown = head.visible(html)
        title, meta, canonical = head.title(shown), lambda n: head.meta(shown, n), head.canonical(shown)
    return df.withColumns(
        {
            "title": title,
            "description": meta("description"),
            "canonical": canonical,
            "noindex": F.coalesce(F.contains(F.lower(meta("robots")), F.lit("noindex")), F.lit(False)),
            "blocked": F.coalesce(F.col("status").isin(403, 429), F.lit(False)) | F.coalesce(F.substring(html, 1, 1200).rlike(BLOCKED), F.lit(False)),
        }
    ).drop(body)


def _checks(profile: str) -> Column:
    """The issues of a page as an array, in order of emission."""
    preview = profile == "preview"
    generated = F.col("page_type").isin(*GENERATED)
    mild = F.when(generated, "notice").otherwise("warning")
    status, hops, loop = F.coalesce("status", F.lit(0)), F.col("n_hops"), F.coalesce("loop", F.lit(False))
    title, description = T.utf16_length(F.col("title")), T.utf16_length(F.col("description"))
    moved = F.coalesce(F.col("__final") != F.col("__url"), F.lit(False))
    canon = F.col("__canon")
    own_host = F.coalesce(F.col("__canon_host") == F.col("__host"), F.lit(False))
    same = F.col("__canon_norm").eqNullSafe(F.col("__url")) | F.col("__canon_norm").eqNullSafe(F.col("__final"))
    kind = F.coalesce("content_type", F.lit(""))

    def text(form: str, *values: Column) -> Column:
        return F.format_string(form, *values) if values else F.lit(form)

    redirect_text = "Page returned HTTP %d." if preview else "Page returned redirect status %d."
    short_title = (title < 15, "notice", "SHORT_TITLE", text("Title is very short."))
    long_title = (title > 75, mild, "LONG_TITLE", text("Title may be too long." if preview else "Title may be too long for search results."))
    short_desc = (description < 50, "notice", "SHORT_META_DESCRIPTION", text("Meta description is short."))
    long_desc = (description > 180, mild, "LONG_META_DESCRIPTION", text("Meta description may be too long."))
    checks = [
        (status == 0, "error", "FETCH_FAILED", text("Page could not be fetched.")),
        (status >= 400, "error", "BAD_STATUS", text("Page returned HTTP %d.", status)),
        (status.between(300, 399) & ~loop & (hops == 0), "warning", "REDIRECT_STATUS", text(redirect_text, status)),
        (loop, "error", "REDIRECT_LOOP", text("Sitemap URL enters a redirect loop.")),
        (~loop & (hops >= 2), "warning", "REDIRECT_CHAIN", text("Sitemap URL passes through %d redirects before resolving.", hops)),
        (~loop & ((hops == 1) | ((hops < 2) & moved)), "warning", "REDIRECTED_URL", text("Sitemap URL resolves to %s.", F.col("final_url"))),
    ]
    if preview:
        checks += [
            ((kind != "") & ~kind.rlike(r"(?i)html|xhtml|text/"), "notice", "NON_HTML_RESPONSE", text("Response content-type was %s.", kind)),
            (F.col("blocked"), "warning", "BOT_PROTECTION_DETECTED", text("Page response looks like bot protection or an access challenge.")),
        ]
    checks += [
        (F.col("title").isNull(), mild, "MISSING_TITLE", text("Page is missing a title tag." if preview else "Page is missing a <title> tag.")),
        *((long_title, short_title) if preview else (short_title, long_title)),
        (F.col("description").isNull(), mild, "MISSING_META_DESCRIPTION", text("Page is missing a meta description.")),
        *((long_desc, short_desc) if preview else (short_desc, long_desc)),
        (F.col("canonical").isNull(), "notice", "MISSING_CANONICAL", text("Page is missing a canonical link.")),
        (canon.isNotNull() & ~own_host, "warning", "CANONICAL_CROSS_HOST", text("Canonical points to another host: %s.", canon)),
        (canon.isNotNull() & own_host & ~same, "notice", "CANONICAL_MISMATCH", text("Canonical points to a different URL: %s.", canon)),
        (F.col("noindex"), "error", "NOINDEX_IN_SITEMAP", text("Page appears in sitemap but has noindex." if preview else "Page appears in sitemap but has a noindex robots directive.")),
        (T.empty_to_null(F.col("lastmod")).isNull(), mild, "MISSING_LASTMOD", text("Sitemap entry is missing lastmod.")),
    ]
    if preview:
        checks.append((F.col("error").isNotNull(), "notice", "FETCH_DETAIL", F.col("error")))
    made = [
        F.when(cond, F.struct(F.lit(i).alias("ord"), (F.lit(sev) if isinstance(sev, str) else sev).alias("severity"), F.lit(code).alias("code"), message.alias("message")))
        for i, (cond, sev, code, message) in enumerate(checks)
    ]
    return F.array_compact(F.array(*made))


def check_pages(entries: DataFrame, profile: str = "full") -> DataFrame:
    """Pages with ``issues`` and ``ok``, of ``entries`` joined to their resolved fetch.

    Input: site, url, lastmod, changefreq, priority, status, final_url, content_type, n_hops, loop,
    error, title, description, canonical, noindex, blocked; missing ones count as null. One pass
    makes all issues of a page. ``ok`` is that no check is an error; later issues never are.
    """
    defaults = {
        "changefreq": "string", "priority": "string", "final_url": "string", "content_type": "string", "n_hops": "int", "loop": "boolean",
        "error": "string", "blocked": "boolean", "noindex": "boolean", "chain": "array<struct<url:string,status:int,location:string>>",
    }
    for name, kind in defaults.items():
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(None).cast(kind))
    df = entries.withColumns({"n_hops": F.coalesce("n_hops", F.lit(0)), "noindex": F.coalesce("noindex", F.lit(False)), "blocked": F.coalesce("blocked", F.lit(False))})
    # URLs are parsed once, into columns that the checks compare.
    df = U.enrich_urls(df, profile).withColumns(
        {
            "__url": F.coalesce("norm_url", "url"),
            "__host": F.col("host"),
            "__final": F.coalesce(U.norm_url(F.col("final_url")), "final_url"),
            "__canon": U.resolve_url(F.col("canonical"), F.col("url")),
        }
    )
    df = df.withColumns({"__canon_norm": U.norm_url(F.col("__canon")), "__canon_host": U.url_host(F.col("__canon"))})
    df = df.withColumn("issues", _checks(profile))
    return df.select(
        "site", "url", "path", "display_path", "section", "page_type", "title", "description", "canonical", "final_url", "lastmod", "changefreq", "priority", "status",
        F.nullif("n_hops", F.lit(0)).alias("redirects"), F.when(F.col("n_hops") > 0, F.col("chain")).alias("redirect_chain"),
        (~F.exists("issues", lambda i: i["severity"] == "error")).alias("ok"), "issues",
    )


def index_only(entries: DataFrame) -> DataFrame:
    """Pages of the preview's entries beyond its deep sample."""
    url = F.col("url")
    note = F.array(F.struct(F.lit(0).alias("ord"), F.lit("notice").alias("severity"), F.lit("INDEX_ONLY_NOT_FETCHED").alias("code"), F.lit("URL was indexed from sitemap but not deep-fetched in this preview.").alias("message")))
    return entries.select("site", "url", U.path(url).alias("path"), U.display_path(url).alias("display_path"), U.section(url, "preview").alias("section"), U.page_type(url, "preview").alias("page_type"), "lastmod", F.lit(True).alias("ok"), note.alias("issues"))


def deep_sample(entries: DataFrame, max_deep: int = MAX_DEEP, collation: str | None = None) -> DataFrame:
    """``entries`` with deep_checked: whether the URL is among its site's first ``max_deep``, by ``collation`` if given."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy(*T.collated("url", collation)))
    # A filtered rank is limited before the shuffle, so that a huge site isn't sorted in one task.
    first = entries.select("site", "url").withColumn("n", rank).where(F.col("n") <= max_deep).select("site", "url", F.lit(True).alias("deep_checked")).distinct()
    return entries.join(first, ["site", "url"], "left").withColumn("deep_checked", F.coalesce("deep_checked", F.lit(False)))


def page_issues(pages: DataFrame, stage: int = 0) -> DataFrame:
    """(site, url, stage, ord, severity, code, message), one row per issue."""
    return pages.select("site", "url", F.lit(stage).alias("stage"), F.inline("issues"))
