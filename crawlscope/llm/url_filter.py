"""URL filters: suffix and prefix rules, and block decisions carried to redirect aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .common import Scratch, lower_ascii, small
from .components import connected_components

#: Index pages that servers redirect to their folder, and query parameters that track a visit.
INDEX_PAGES = ("index.html", "index.htm", "index.php")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")

_CANONICAL = r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"
_REFRESH = r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def rules_frame(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, rule_host, rule_path, action) from pairs of ``host/path`` and allow or block."""
    rows = [(r, r.split("/", 1)[0], "/" + r.split("/", 1)[1], action) for r, action in rules]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, action string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The node of a URL in the alias graph: host, path and query; scheme and fragment don't count.

    A URL that parses is taken in the parser's form, as the targets of links are.
    """

    def node(u: Column) -> Column:
        query = F.regexp_extract(u, r"(?s)\A.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
        path = path_of(u)
        return F.concat(host_of(u), F.when(path == "", F.lit("/")).otherwise(path), query)

    return U.let(F.coalesce(U.resolve_url(url, url), url), node)


def usual_form(node: Column) -> Column:
    """The node that servers usually redirect ``node`` to, and pages give as their canonical link.

    Without ``www.`` or ``m.`` where at least two labels are left, without an index page, with a slash
    at the end of a path that names no file, and without tracking parameters; the other parameters
    keep their order. The usual form of a usual form is itself.
    """
    host = F.regexp_replace(F.regexp_extract(node, r"(?s)\A([^/]*)", 1), r"\A(?:(?:www|m)\.)+([^.]+\.)", "$1")
    path = F.regexp_replace(F.regexp_extract(node, r"(?s)\A[^/]*(/[^?]*)", 1), rf"/({'|'.join(x.replace('.', '[.]') for x in INDEX_PAGES)})\z", "/")
    folder = F.when(path.rlike(r"(/|\.[A-Za-z0-9]+)\z"), path).otherwise(F.concat(path, F.lit("/")))
    query = F.regexp_replace(F.regexp_extract(node, r"(?s)\A[^?]*(\?.*)", 1), rf"(?<=[?&])({'|'.join(TRACKING)})(=[^&]*)?(&|\z)", "")
    return F.concat(host, folder, F.regexp_replace(query, r"[?&]+\z", ""))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(host, path, ...)`` with the longest fitting rule and its action, null without one.

    A rule fits its host and all subdomains where the path starts with the rule's. Distinct hosts
    and paths are joined with the rules on each suffix of the host, so that the work is that of the
    candidates of a host, whatever the number of rules.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        urls.select("host", "path")
        .where("host <> ''")
        .distinct()
        .withColumn("rule_host", F.explode(suffixes))
        .join(small(rules), "rule_host")
        .where(F.startswith("path", "rule_path"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "rule", "action")).alias("hit"))
        .select("host", "path", "hit.rule", "hit.action")
    )
    return urls.join(best, ["host", "path"], "left")


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs of canonical links and meta refreshes in ``pages(url, html)``.

    Entities are decoded, and targets resolved against the page's URL; a page whose URL doesn't parse
    may state absolute targets, or such that begin with ``//`` or ``/`` or are relative to its folder.
    """
    html, url = F.col("html"), F.col("url")
    found = F.array(
        T.decode_entities(F.regexp_extract(F.regexp_extract(html, _CANONICAL, 1), _HREF, 1)),
        F.regexp_extract(T.decode_entities(F.regexp_extract(html, _REFRESH, 1)), _TARGET, 1),
    )
    link = F.explode(F.when(html.rlike(r"(?i)canonical|http-equiv"), F.filter(found, lambda x: x != ""))).alias("href")
    origin = F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*)", 1)
    href = F.col("href")
    target = (
        F.when(U.is_url(url), U.resolve_url(href, url))
        .when(href.contains("://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)\A(.*?:)//", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?") | href.startswith("#"), F.concat(origin, path_of(url), href))
        .otherwise(F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"(?s)\A(.*/)", 1), F.lit("")), F.lit("/")), href))
    )
    return pages.where(url.contains("://")).select(url.alias("url"), link).select(F.col("url").alias("src"), target.alias("dst"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", usual: bool = False
) -> DataFrame:
    """Verdict on every row of ``pages``: (page_id, host, path, rule, verdict).

    A URL with a rule has the rule's verdict. Another URL has that of its aliases, the URLs that
    ``links(src, dst)`` (redirects and canonical links, either way) connect with it: allow if a rule
    allows any of them, else block if a rule blocks any, else ``default``. With ``usual`` a URL is also
    an alias of its usual form (:func:`usual_form`), as if its site redirected there.

    A null URL or one without ``://`` has an empty host and path, no rule, and ``default``. Repeated
    rows each get their row; nulls in links link nothing; no rows give no rows. Other columns are
    ignored, whatever their names.
    """
    with Scratch(pages.sparkSession, "url-filter") as scratch:
        return scratch.keep(_judged(pages, rules, links, id_col, url_col, default, usual, scratch))


def _verdicts(matched: DataFrame, key: str) -> DataFrame:
    """(key, allowed, blocked) of rows with an action; a key without any is left out."""
    hit = matched.where("action IS NOT NULL").groupBy(key)
    return hit.agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))


def _judged(pages: DataFrame, rules: DataFrame, links: DataFrame, id_col: str, url_col: str, default: str, usual: bool, scratch: Scratch) -> DataFrame:
    url = F.col(url_col)
    # URLs with one usual form are aliases of it: they form a star, which needs no search for components.
    form = usual_form if usual else lambda n: n
    rows = scratch.write(pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")).withColumn("key", form(F.col("node"))))
    stated = links.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src <> '/' AND dst <> '/'")
    stated = scratch.write(stated.withColumns({"src_key": form(F.col("src")), "dst_key": form(F.col("dst"))}).distinct())
    nodes = rows.select("node", "key").union(stated.select("src", "src_key")).union(stated.select("dst", "dst_key")).where("node <> '/'")
    nodes = nodes.union(nodes.select("key", "key")).distinct()
    told = match_rules(nodes.select("key", F.regexp_extract("node", r"(?s)\A([^/]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)\A[^/]*(/[^?]*)", 1).alias("path")), rules)
    by_key = _verdicts(told, "key")
    edges = stated.where("src_key <> dst_key").select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst")).distinct()
    if not edges.isEmpty():
        # Only the groups that links touch are connected any further.
        comp = scratch.write(connected_components(scratch.write(edges), scratch)).withColumnRenamed("node", "key")
        by_key = scratch.write(by_key)
        linked = by_key.join(comp, "key").groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
        by_key = by_key.join(comp.select("key"), "key", "left_anti").unionByName(comp.join(linked, "component").select("key", "allowed", "blocked"))
    alias = by_key.select("key", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias_verdict"))
    return match_rules(rows, rules).join(small(alias, size="octet_length(key)"), "key", "left").select("page_id", "host", "path", "rule", F.coalesce("action", "alias_verdict", F.lit(default)).alias("verdict"))


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]], **options) -> DataFrame:
    """:func:`judge_urls` over the links that the pages themselves state, and their URLs' usual forms."""
    return judge_urls(pages, rules_frame(pages.sparkSession, rules), page_links(pages), **{"usual": True, **options})
