"""Text columns with the white space, length and entity rules of web scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of ECMAScript's ``\s`` and ``trim``.
SPACE = r"[\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: The entities that are decoded, in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed; null if nothing is left."""
    return empty_to_null(trim(F.regexp_replace(c, f"{SPACE}+", " ")))


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def clean_html(c: Column) -> Column:
    """Entities decoded, then tags dropped, then white space collapsed; null if nothing is left."""
    return collapse(F.regexp_replace(decode_entities(c), "<[^>]+>", ""))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, as scripts count it."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def humanize(c: Column) -> Column:
    """``_`` to a space and the first letter of each word upper-cased, the rest as it is.

    Words are separated by blanks; codes and types are ASCII.
    """
    words = F.split(F.replace(c, F.lit("_"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing or an empty string matches."""
    return empty_to_null(F.regexp_extract(c, pattern, group))


def collated(name: str, collation: str | None) -> list[Column]:
    """Sort keys of a text column: by code point, or by a collation such as ``UNICODE`` and then by code point."""
    return [F.col(name)] if collation is None else [F.collate(F.col(name), collation), F.col(name)]
