"""URL columns: parts, normal forms, classification and resolution.

URLs are split with one expression, so nothing throws: a string that isn't an absolute http(s) URL
gives null. Internationalised hosts are lower-cased; within :func:`ascii_hosts` they get their ASCII form.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .idna import ascii_host

_URL = r"(?is)\A(https?)://(?:([^/?#@]*)@)?((?:\[[0-9a-f:.]+\]|[^/?#:@\x{20}\[\]<>|^%\\]+))(?::([0-9]*))?([/\\][^?#]*)?(\?[^#]*)?(#.*)?\z"
#: A URL in normal form without login, port, fragment, dot segments and percent signs in its path; its parts stand there as they are.
_PLAIN = r"\Ahttps?://[a-z0-9.-]++(?:/[A-Za-z0-9_~-][A-Za-z0-9_.~-]*+)++(?:\?[A-Za-z0-9_.~=&%+-]++)?\z"
#: The same, or an origin.
_PLAIN_HOST = _PLAIN.replace(")++(?:", ")*+(?:")

#: First path segments of category pages.
CATEGORIES = ("c", "category", "categories", "tag", "tags", "topic", "topics")
#: Sitemap paths tried without a usable directive.
COMMON_SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml", "/sitemap/sitemap.xml")


#: Whether columns made now give hosts in their ASCII form.
_ASCII: ContextVar[bool] = ContextVar("ascii_hosts", default=False)


@contextmanager
def ascii_hosts(on: bool = True) -> Iterator[None]:
    """URL columns made inside have internationalised hosts in their ASCII form, so that both spellings of a URL are one.

    The conversion is a large expression in every URL column, which made audits of a small table
    slower, so it is left out where no such hosts are expected.
    """
    token = _ASCII.set(on)
    try:
        yield
    finally:
        _ASCII.reset(token)


def _host(c: Column) -> Column:
    return ascii_host(c) if _ASCII.get() else F.lower(c)


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _quick(c: Column, plain, other, form: str = _PLAIN) -> Column:
    """``plain`` of a URL of the plain ``form``, which one match tells; ``other`` of the rest."""
    return let(c, lambda x: F.when(x.rlike(form), plain(x)).otherwise(other(x)))


def _escape(c: Column) -> Column:
    """Percent-encodes white space, quotes, angle brackets and non-ASCII characters, nothing else."""
    plain = r"\x21\x23-\x3B\x3D\x3F-\x7E"

    def encoded(x: Column) -> Column:
        runs = F.regexp_extract_all(x, F.lit(f"[{plain}]+|[^{plain}]+"), F.lit(0))
        return F.when(x.rlike(f"[^{plain}]"), F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{plain}]"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20")))), "")).otherwise(x)

    return let(c, encoded)


def _without_dots(c: Column) -> Column:
    """``.`` and ``..`` segments resolved; a path that ends with one ends with ``/``."""

    def resolved(path: Column) -> Column:
        parts = F.split(F.concat(path, F.when(path.rlike(r"(?i)/(\.|%2e){1,2}\z"), "/").otherwise("")), "/")
        up = lambda s: s.rlike(r"(?i)\A(\.|%2e){2}\z")
        here = lambda s: s.rlike(r"(?i)\A(\.|%2e)\z")
        stack = F.aggregate(
            F.slice(parts, 2, F.size(parts)),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(up(s), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(here(s), acc).otherwise(F.concat(acc, F.array(s))),
        )
        return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|\z)"), F.concat(F.lit("/"), F.array_join(stack, "/"))).otherwise(path)

    return let(c, resolved)


def _pieces(c: Column) -> Column:
    """The seven groups of the URL pattern; a single one for what is no URL."""
    return F.split(F.regexp_replace(T.trim(c), _URL, "$1\x01$2\x01$3\x01$4\x01$5\x01$6\x01$7"), "\x01")


def _at(u: Column, i: int) -> Column:
    return F.get(u, F.lit(i))


def _path_of(u: Column) -> Column:
    return let(F.translate(_at(u, 4), "\\", "/"), lambda raw: F.when(raw == "", "/").otherwise(_without_dots(_escape(raw))))


def parse(c: Column) -> Column:
    """Parts of a URL: scheme, login, host, port, path, query, search, fragment; null if it is none.

    ``port`` is ``:n`` unless it is the scheme's default; ``query`` is as it stands, maybe a mere
    ``?``, and ``search`` is empty then.
    """

    def build(u: Column) -> Column:
        default = F.when(F.lower(_at(u, 0)) == "https", "443").otherwise("80")
        parts = F.struct(
            F.lower(_at(u, 0)).alias("scheme"),
            F.when(_at(u, 1) == "", "").otherwise(F.concat(_at(u, 1), F.lit("@"))).alias("login"),
            _host(_at(u, 2)).alias("host"),
            F.when((_at(u, 3) == "") | (_at(u, 3) == default), "").otherwise(F.concat(F.lit(":"), _at(u, 3))).alias("port"),
            _path_of(u).alias("path"),
            _escape(_at(u, 5)).alias("query"),
            F.when(_at(u, 5) == "?", "").otherwise(_escape(_at(u, 5))).alias("search"),
            _at(u, 6).alias("fragment"),
        )
        return F.when(F.size(u) == 7, parts)

    return let(_pieces(c), build)


def _piece(c: Column, of) -> Column:
    """One part of a URL, without building the others; null for what is none."""
    return let(_pieces(c), lambda u: F.when(F.size(u) == 7, of(u)))


def _stripped(p: Column) -> Column:
    """Path without trailing slashes, ``/`` if nothing is left."""
    return F.regexp_replace(F.regexp_replace(p, r"/+\z", ""), r"\A\z", "/")


def _origin(s: Column) -> Column:
    return F.concat(s["scheme"], F.lit("://"), s["host"], s["port"])


def _norm(s: Column) -> Column:
    return F.concat(s["scheme"], F.lit("://"), s["login"], s["host"], s["port"], _stripped(s["path"]), s["query"])


def _key(s: Column) -> Column:
    path = F.when(s["path"].isin("/index.html", "/index.htm"), "/").otherwise(_stripped(s["path"]))
    return F.concat(_origin(s), path, s["search"])


def _href(s: Column) -> Column:
    return F.concat(s["scheme"], F.lit("://"), s["login"], s["host"], s["port"], s["path"], s["query"], s["fragment"])


def _segments(s: Column) -> Column:
    return F.filter(F.split(s["path"], "/"), lambda x: x != "")


def _type_of(s: Column, profile: str) -> Column:
    def of(p: Column) -> Column:
        p0, n = F.get(p, F.lit(0)), F.size(p)
        category = F.lit("category") if profile == "preview" else F.when(s["search"] != "", "category_page").otherwise("category")
        out = (
            F.when(p.isNull(), F.lit(None))
            .when(n == 0, "home")
            .when(p0.isin("archive", "cluster", "canvas"), p0)
            .when(p0.isin("source", "sources"), "source")
            .when(p0.isin("story", "stories"), "story")
            .when(p0.isin(*CATEGORIES), category)
        )
        if profile != "preview":
            out = out.when(s["search"].rlike(r"(?i)(^|[?&])page=[0-9]+"), "category_page")
        return out.when(n == 1, "static").otherwise("generated")

    return let(_segments(s), of)


def _section_of(s: Column, profile: str) -> Column:
    def of(p: Column) -> Column:
        p0, p1 = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        if profile == "preview":
            return F.when(p.isNotNull(), F.coalesce(p0, F.lit("home")))
        return F.when(
            p.isNotNull(),
            F.when(p0.isNull(), "home")
            .when(p0.isin(*CATEGORIES) & p1.isNotNull(), F.concat_ws("/", p0, p1))
            .when((p0 == "canvas") & p1.isNotNull(), "canvas/archive")
            .otherwise(p0),
        )

    return let(_segments(s), of)


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(_PLAIN_HOST) | T.trim(c).rlike(_URL), F.lit(False))


def scheme(c: Column) -> Column:
    return _piece(c, lambda u: F.lower(_at(u, 0)))


def url_host(c: Column) -> Column:
    """Lower-cased host name; null for what is no URL."""
    return _quick(c, lambda x: F.regexp_extract(x, r"\Ahttps?://([^/?]*+)", 1), lambda x: _piece(x, lambda u: _host(_at(u, 2))), _PLAIN_HOST)


def path(c: Column) -> Column:
    """Path of a URL, ``/`` if it has none; null for what is no URL."""
    return _quick(c, lambda x: F.regexp_extract(x, r"\Ahttps?://[^/]++([^?]*+)", 1), lambda x: _piece(x, _path_of))


def display_path(c: Column) -> Column:
    return _quick(c, lambda x: F.regexp_extract(x, r"\Ahttps?://[^/]++(.*+)", 1), lambda x: let(parse(x), lambda s: F.concat(s["path"], s["search"])))


def request_path(c: Column) -> Column:
    """What robots rules are matched against; ``/`` for what is no URL."""
    return F.coalesce(display_path(c), F.lit("/"))


def norm_url(c: Column) -> Column:
    """Fragment and default port dropped, host lower-cased, trailing slashes of the path stripped."""
    return _quick(c, lambda x: x, lambda x: let(parse(x), _norm))


def dedupe_key(c: Column) -> Column:
    """As :func:`norm_url`, without login and empty query, and with a root index page as ``/``."""
    return _quick(c, lambda x: F.regexp_replace(x, r"\A(https?://[^/]++/)index\.html?(?=\?|\z)", "$1"), lambda x: let(parse(x), _key))


def norm_site(c: Column) -> Column:
    """A site as ``https://host/path``: scheme added, query, fragment and trailing slashes dropped."""
    full = let(T.trim(c), lambda t: F.when(t.rlike(r"(?i)\Ahttps?://"), t).otherwise(F.concat(F.lit("https://"), t)))
    return let(parse(full), lambda s: F.concat(_origin(s), F.regexp_replace(s["path"], r"/+\z", "")))


def origin(c: Column) -> Column:
    return let(parse(c), _origin)


def same_host(a: Column, b: Column) -> Column:
    """Host names are equal; scheme and port don't count, and ``www.`` does."""
    return F.coalesce(url_host(a) == url_host(b), F.lit(False))


def page_type(c: Column, profile: str = "full") -> Column:
    """Type of a page by its URL; the preview profile knows no category_page."""
    return let(parse(c), lambda s: _type_of(s, profile))


def section(c: Column, profile: str = "full") -> Column:
    """Section of a page by its URL; the preview profile takes the first segment."""
    return let(parse(c), lambda s: _section_of(s, profile))


def is_sitemap_url(c: Column) -> Column:
    p = let(F.lower(path(c)), lambda p: ~p.rlike(r"/(llms|robots)\.txt\z") & p.rlike(r"sitemap|\.xml(\.gz)?\z"))
    return F.coalesce(p, F.lit(False))


def is_page_url(c: Column) -> Column:
    return F.coalesce(~F.lower(path(c)).rlike(r"(\.xml|\.xml\.gz|/llms\.txt|/robots\.txt)\z"), F.lit(False))


def resolve_url(href: Column, base: Column) -> Column:
    """``href`` as an absolute URL against ``base``; null if it can't be resolved."""

    def against(h: Column, b: Column) -> Column:
        return (
            F.when(h.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
            .when(h.startswith("/"), F.concat(_origin(b), h))
            .when(h.startswith("?"), F.concat(_origin(b), b["path"], h))
            .when(h.startswith("#") | (h == ""), F.concat(_origin(b), b["path"], b["search"], h))
            .otherwise(F.concat(_origin(b), F.regexp_replace(b["path"], r"[^/]*\z", ""), h))
        )

    def resolved(x: Column) -> Column:
        return let(parse(let(T.trim(x), lambda h: let(parse(base), lambda b: against(h, b)))), _href)

    return _quick(href, lambda x: x, resolved)


def sorted_urls(df: DataFrame, col: str = "url") -> DataFrame:
    """Distinct normal forms of the URLs in ``col``, in order."""
    return df.select(norm_url(F.col(col)).alias("url")).where("url IS NOT NULL").distinct().orderBy("url")


def enrich_urls(df: DataFrame, profile: str = "full", col: str = "url") -> DataFrame:
    """``df`` with norm_url, dedupe_key, host, path, display_path, request_path, page_type, section."""
    u = F.col("__u")
    columns = {
        "norm_url": _norm(u),
        "dedupe_key": _key(u),
        "host": u["host"],
        "path": u["path"],
        "display_path": F.concat(u["path"], u["search"]),
        "request_path": F.coalesce(F.concat(u["path"], u["search"]), F.lit("/")),
        "page_type": _type_of(u, profile),
        "section": _section_of(u, profile),
    }
    return df.withColumn("__u", parse(F.col(col))).withColumns(columns).drop("__u")


def input_mode(c: Column) -> Column:
    """``sitemap`` for an address of a sitemap, else ``site``."""
    full = let(T.trim(c), lambda t: F.when(t.rlike(r"(?i)\Ahttps?://"), t).otherwise(F.concat(F.lit("https://"), t)))
    return F.when(is_sitemap_url(full), "sitemap").otherwise("site")


def host_variants(c: Column) -> Column:
    """Origins to try for a site: its own, then its twin with or without ``www.``."""

    def both(s: Column) -> Column:
        host = s["host"]
        twin = F.when(host.startswith("www."), F.regexp_replace(host, r"\Awww\.", "")).otherwise(F.concat(F.lit("www."), host))
        return F.array_distinct(F.array(_origin(s), F.concat(s["scheme"], F.lit("://"), twin)))

    return let(parse(c), both)
