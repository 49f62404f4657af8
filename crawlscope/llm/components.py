"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges(src, dst)`` may hold nulls, self loops and repeats in either direction; nulls and self
    loops link nothing. Returns ``(node, component)``, one row per node, and no row where there is
    no edge. Each round is two aggregations and two joins on node keys; the edges never leave the
    executors, and a written table cuts the lineage after every round.
    """
    e = scratch.write(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )
    seen = _signature(e)
    for _ in range(max_rounds if seen[0] else 0):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
        near = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = (
            e.join(near, e["lo"] == near["u"]).select("hi", F.col("m").alias("lo")).where("hi <> lo").distinct()
        )
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small_star = (
            large.join(low, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(low.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        new = scratch.write(small_star)
        now = _signature(new)
        scratch.drop(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("connected components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        e.select("lo", "lo").distinct()
    )
