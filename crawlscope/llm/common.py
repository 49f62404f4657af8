"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import BROADCAST_ROWS, Scratch, scratch_root, small

__all__ = ["BLANKS", "BROADCAST_ROWS", "Scratch", "absent", "lower_ascii", "ranked", "releasing", "scratch_root", "small", "table"]

#: White space of the word rule `[^\x20\x09-\x0D]+`.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def absent(df: DataFrame, *names: str) -> list[str]:
    """``names``, underscores put before them until ``df`` has no such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; what Arrow's pool no longer uses goes back to the system after each batch.

    A Python worker outlives its task, and its memory counts as the executor's in every later one.
    """

    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in run(batches):
            yield batch
            del batch
            pool.release_unused()

    return out


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    ``lower`` does the same, and much faster, where no other character has a lower case;
    characters that the pattern does not know (``Cn``) may have one. Few texts without capitals
    beyond ASCII hold a character that the cheap class excludes.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = (
        (F.octet_length(text) == F.char_length(text))
        | ~text.rlike(r"[^\x00-\xBF\xDF-\xFF]")
        | ~text.rlike(r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]")
    )
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def ranked(df: DataFrame, scratch: Scratch, group: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the place ``pos`` of each row in its group, the group's ``size`` and a number ``start`` that orders groups.

    Rows are dealt out by ranges of group and order, nulls first, so that a large group spreads over
    many tasks; what is put together per group is one row for each partition that holds it. Without
    ``order`` places are arbitrary; rows alike in all keys get places in any order. The input's
    columns must not be named as those that are added, ``at``, ``part``, ``first`` or ``before``.
    """
    keys = [*group, *order]
    if keys:
        df = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    d = scratch.write(df.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = d.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count("*").alias("run"))
    runs = runs.select(*group, "part", "first", F.coalesce(F.sum("run").over(earlier), F.lit(0)).alias("before"), F.sum("run").over(whole).alias("size"), F.min("first").over(whole).alias("start"))
    runs = scratch.write(runs)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, "part")]
    out = d.alias("d").join(small(runs).alias("r"), same)
    return out.select("d.*", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "size", "start").drop("at", "part")
