"""Head elements as a document's tree has them: outside comments, scripts and styles, with every entity decoded."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .urls import let

#: A tag's inside: quoted values may hold any character.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: What hides markup, in one scan from left to right, so that the first opener counts; a title is kept, for markup
#: in it is text. The elements whose content is no markup.
_HIDDEN = rf"(?is)(<title\b{_INSIDE}>.*?(?:</title\s*>|\z))|<!--.*?(?:--!?>|\z)|<(script|style|textarea|xmp|iframe|noembed|noframes)\b{_INSIDE}>.*?(?:</\2[\s/>]|\z)"
_ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_ENTITY = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?|[^&]+|&"


def _table(pairs: dict[str, str]) -> Column:
    """A constant map; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _names() -> dict[str, str]:
    """Characters of all named entities, by name, and with ``;`` where the standard requires it."""
    return dict(html5)


def _windows() -> dict[str, str]:
    """Characters of the code points that stand for those of code page 1252."""
    out = {}
    for code in range(0x80, 0xA0):
        char = bytes([code]).decode("cp1252", errors="ignore")
        if char:
            out[str(code)] = char
    return out


def decode_all(c: Column) -> Column:
    """Every named and numeric entity of HTML decoded, once; what is none stays as it is.

    A name without ``;`` is decoded where the standard allows it and no letter or digit follows. Code
    points that are none, and surrogates, give U+FFFD.
    """

    def number(e: Column) -> Column:
        digits = F.regexp_extract(e, r"&#[xX]?0*([0-9A-Fa-f]*);?", 1)
        value = F.when(F.length(digits) > 7, F.lit(0)).when(e.rlike("^&#[xX]"), F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("int")).otherwise(F.concat(F.lit("0"), digits).cast("int"))
        return let(value, lambda n: F.coalesce(
            F.try_element_at(_table(_windows()), n.cast("string")),
            F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("�")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")),
        ))

    def one(e: Column) -> Column:
        return F.when(e.startswith("&#") & (F.length(e) > 2), number(e)).when(e.startswith("&"), F.coalesce(F.try_element_at(_table(_names()), F.substring(e, 2, 64)), e)).otherwise(e)

    return let(c, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0)), one), "")).otherwise(t))


def visible(html: Column) -> Column:
    """``html`` without comments and the elements whose content is no markup; titles stay whole."""
    return F.regexp_replace(html, _HIDDEN, "$1")


def _value(tag: Column, name: str) -> Column:
    """The first value of an attribute, without its quotes; null if there is none."""

    def of(tag_text: Column) -> Column:
        names = F.transform(F.regexp_extract_all(tag_text, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
        values = F.regexp_extract_all(tag_text, F.lit(_ATTRIBUTE), F.lit(2))
        return F.regexp_replace(F.get(values, F.array_position(names, name).cast("int") - 1), r"""(?s)\A(["'])(.*)\1\z""", "$2")

    return let(tag, of)


def _first_tag(shown: Column, element: str, name: str, value: str, fold: bool) -> Column:
    """The first ``element`` whose attribute ``name`` is ``value``."""
    tags = F.regexp_extract_all(shown, F.lit(rf"(?i)<{element}(?=[\s/]){_INSIDE}>"), F.lit(0))
    told = lambda t: F.lower(_value(t, name)) if fold else _value(t, name)
    return F.get(F.filter(tags, lambda t: told(t) == value), F.lit(0))


def title(shown: Column) -> Column:
    """Text of the first title, white space collapsed; null if it is empty. ``shown`` is what :func:`visible` leaves."""
    return T.collapse(decode_all(F.regexp_extract(shown, rf"(?is)<title\b{_INSIDE}>(.*?)(?:</title\s*>|\z)", 1)))


def meta(shown: Column, name: str) -> Column:
    """Content of the first meta element of this very name."""
    return T.collapse(decode_all(_value(_first_tag(shown, "meta", "name", name, False), "content")))


def canonical(shown: Column) -> Column:
    """Target of the first canonical link, whatever the case of its relation."""
    return T.collapse(decode_all(_value(_first_tag(shown, "link", "rel", "canonical", True), "href")))


def alternates(shown: Column) -> Column:
    """(lang, href) of the alternate links that state a language, as they stand there; lang in lower case."""
    tags = F.regexp_extract_all(shown, F.lit(rf"(?i)<link(?=[\s/]){_INSIDE}>"), F.lit(0))
    told = F.transform(tags, lambda t: F.struct(F.lower(_value(t, "rel")).alias("rel"), F.lower(T.trim(_value(t, "hreflang"))).alias("lang"), T.trim(decode_all(_value(t, "href"))).alias("href")))
    own = F.filter(told, lambda t: t["rel"].rlike(r"(^|\s)alternate(\s|$)") & (t["lang"] != "") & (t["href"] != ""))
    return F.transform(own, lambda t: F.struct(t["lang"].alias("lang"), t["href"].alias("href")))


def open_graph(shown: Column) -> Column:
    """Names of the OpenGraph properties that have a content, distinct and in order."""
    tags = F.regexp_extract_all(shown, F.lit(rf"(?i)<meta(?=[\s/]){_INSIDE}>"), F.lit(0))
    filled = F.filter(tags, lambda t: F.lower(_value(t, "property")).startswith("og:") & (T.trim(_value(t, "content")) != ""))
    return F.array_sort(F.array_distinct(F.transform(filled, lambda t: F.lower(_value(t, "property")))))


def schema_types(html: Column) -> Column:
    """Types that the page's JSON-LD states for its top nodes, lists and graphs, distinct and in order; no JSON gives none."""
    scripts = F.regexp_extract_all(
        F.regexp_replace(html, r"(?s)<!--.*?(?:--!?>|\z)", ""), F.lit(r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json\b[^>]*>(.*?)</script"), F.lit(1)
    )
    none = F.array().cast("array<variant>")
    nodes = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    every = F.flatten(F.transform(scripts, lambda s: F.coalesce(nodes(F.try_parse_json(s)), none)))
    inner = F.flatten(F.transform(every, lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), none)))
    named = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.concat(every, inner), named)), lambda t: t.isNotNull())))
