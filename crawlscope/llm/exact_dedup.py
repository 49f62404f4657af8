"""Exact dedup: heavy digests settled map-side, the rest by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, absent

#: Digests above this share of the rows are found by the frequent-item pass. Its reciprocal bounds
#: the candidates, and with them what is broadcast.
HEAVY_SHARE = 0.005
#: Once the other groups are counted, those above so many rows, or this share of the rows if that is
#: more, are settled where they are read too; so at most the share's reciprocal are broadcast.
LARGE_ROWS, LARGE_SHARE = 1_000_000, 1e-4

#: Characters that equality of texts ignores.
IGNORED = "\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: Column) -> Column:
    """``text`` without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_code_points, text_hash, text_sha256) of each row; the only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_code_points"),
        F.xxhash64(text).alias("text_hash"),
        F.sha2(F.encode(normalised(text), "UTF-8"), 256).alias("text_sha256"),
    )


def _settled(docs: DataFrame, heavy_share: float, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    d = scratch.write(digests(docs, id_col, text_col))
    frequent = d.stat.freqItems(["text_sha256"], heavy_share).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    n = d.count()
    # Longest text first, then the smallest id; nulls last.
    rank = F.struct(F.col("n_code_points"), F.col("doc_id").isNotNull(), -F.col("doc_id"))
    winners = [F.max_by("doc_id", rank).alias("keep_id"), F.max("n_code_points").alias("longest"), F.count("*").alias("group_size")]
    heavy = scratch.write(d.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256").agg(*winners).where(F.col("group_size") > F.lit(heavy_share * n)))
    rest = d.join(F.broadcast(heavy), "text_sha256", "left_anti")
    groups = scratch.write(rest.groupBy("text_sha256").agg(*winners))
    large = groups.where(F.col("group_size") > F.lit(max(LARGE_ROWS, LARGE_SHARE * n)))
    told = d.join(F.broadcast(heavy), "text_sha256").unionByName(rest.join(F.broadcast(large), "text_sha256"))
    few = rest.join(F.broadcast(large.select("text_sha256")), "text_sha256", "left_anti")
    told = told.unionByName(few.join(groups, "text_sha256"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_code_points") == F.col("longest"))
    return told.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "text_hash")


def exact_dedup(docs: DataFrame, heavy_share: float = HEAVY_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict on every row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical without blanks. Of equal texts the row with the most code points
    stays, then the smallest doc_id. A Misra-Gries pass names at most ``1 / heavy_share`` digests;
    their true counts and winners are aggregated, and those that are verified as heavy are broadcast
    so that their rows are settled where they are read. All other digests are aggregated, partially
    before the shuffle, and joined back; of these too, large groups are broadcast.

    Nulls and ties: a null text is an empty one, and all empty texts form one group. A null doc_id
    loses ties to any id; a group of null ids alone keeps null as keep_id with kept true. Rows that
    repeat a doc_id in one group share its verdict; they count in group_size. No rows give no rows.
    Other columns are ignored, whatever their names.
    """
    with Scratch(docs.sparkSession, "exact-dedup") as scratch:
        return scratch.keep(_settled(docs, heavy_share, id_col, text_col, scratch).drop("text_hash"))


def drop_copies(docs: DataFrame, heavy_share: float = HEAVY_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with their columns.

    Rows are told apart by id and text: those that repeat a kept id with its text all stay, one with
    the same id and a text of which another row stays goes. A null doc_id is kept if its group has no
    other.
    """
    kept_id, kept_hash = absent(docs, "kept_id", "kept_hash")
    with Scratch(docs.sparkSession, "exact-dedup") as scratch:
        kept = scratch.keep(
            _settled(docs, heavy_share, id_col, text_col, scratch).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)).distinct()
        )
    same = F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(kept_hash))
    return docs.join(kept, same, "left_semi")
