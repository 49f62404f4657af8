"""Merkle manifest of a dataset: a hash tree of each source, one over the sources, and proofs by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, ranked, small

#: Nodes that are hashed into one.
RUN = 16
#: The tree over the sources' roots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's text behind its length in UTF-8 bytes."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _key(tree: Column, height: Column, pos: Column) -> Column:
    return F.concat_ws(":", tree.cast("string"), height.cast("string"), pos.cast("string"))


def _levels(bottom: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The inner nodes (tree, height, pos, size, digest, children) over ``bottom(tree, pos, size, digest)``, a table for each height."""
    out, level = [], bottom
    most = bottom.agg(F.max("size")).first()[0] or 0
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("pos", "digest")))["digest"]
        up = level.where("size > 1").groupBy("tree", "size", F.floor(F.col("pos") / RUN).alias("up")).agg(run.alias("children"))
        level = scratch.write(
            up.select(
                "tree", F.lit(len(out) + 1).alias("height"), F.col("up").alias("pos"), F.ceil(F.col("size") / RUN).alias("size"), F.sha2(F.array_join("children", ""), 256).alias("digest"), "children"
            )
        )
        out.append(level)
        most = -(-most // RUN)
    return out


def _segment(children: str, slot: str) -> Column:
    """The siblings before and behind a child, each joined into one text."""
    at = F.col(slot)
    before, behind = F.slice(children, F.lit(1), at), F.slice(children, at + 2, F.lit(RUN))
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(behind, "").alias("behind"))


def _parents(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``nodes`` with the key of their parent and their slot in it; null for the root.

    A source's root stands in the tree over sources at the place that ``tops`` tells.
    """
    within = nodes.where("size > 1")
    inner = within.select("*", _key(F.col("tree"), F.col("height") + 1, F.floor(F.col("pos") / RUN)).alias("parent"), (F.col("pos") % RUN).cast("int").alias("slot"))
    ends = nodes.where("size = 1").join(small(tops.select("tree", F.col("pos").alias("rank"), F.col("size").alias("sources"))), "tree", "left")
    above = F.when(F.col("sources") > 1, _key(F.lit(TOP), F.lit(1), F.floor(F.col("rank") / RUN)))
    return inner.unionByName(ends.select(*nodes.columns, above.alias("parent"), (F.col("rank") % RUN).cast("int").alias("slot")))


def _jumped(nodes: DataFrame, tops: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, segment, subroot) of every inner node: its siblings on the whole way to the root.

    Each node starts with the segment to its parent. A self-join then appends the segment of the
    node that it points to and takes over that node's pointer, which doubles the distance; it ends
    when no pointer is left.
    """
    here = _parents(nodes, tops).withColumn("node", _key(F.col("tree"), F.col("height"), F.col("pos")))
    family = nodes.select(_key(F.col("tree"), F.col("height"), F.col("pos")).alias("parent"), F.col("children").alias("family"))
    own_root = F.when((F.col("size") == 1) & (F.col("tree") != TOP), F.col("digest"))
    first = here.join(family, "parent", "left").select(
        "tree", "height", "node", F.col("parent").alias("ahead"), F.when(F.col("parent").isNull(), F.array().cast("array<struct<before:string,behind:string>>")).otherwise(F.array(_segment("family", "slot"))).alias("segment"), own_root.alias("subroot")
    )
    now, distance = scratch.write(first), 1
    while now.where("ahead IS NOT NULL").limit(1).count():
        # A node that others point to over this distance is at least so high, unless it stands over the sources.
        target = now.where((F.col("tree") == TOP) | (F.col("height") > distance)).select(F.col("node").alias("ahead"), F.col("ahead").alias("next"), F.col("segment").alias("more"), F.col("subroot").alias("its_root"))
        target = small(target, 20_000, "length(ahead) + 2000 * size(more)")
        done = now.where("ahead IS NULL")
        going = now.where("ahead IS NOT NULL").join(target, "ahead", "left")
        step = going.select("tree", "height", "node", F.col("next").alias("ahead"), F.concat("segment", F.coalesce("more", F.array())).alias("segment"), F.coalesce("subroot", "its_root").alias("subroot"))
        now, distance = scratch.write(done.unionByName(step)), distance * 2
    return now.select("node", "segment", "subroot")


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, keep_paths: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    A leaf is the digest of the row's ``fields``. Leaves of a source, by doc_id, are hashed in runs
    of RUN until one node remains, and so are the sources' roots, by source. A row's proof is the
    siblings on its way to the root; ``folded_root`` is what leaf and proof give, where rows with
    ``tampered`` true come with A-Z of their text lower-cased. ``keep_paths`` adds the proof itself
    as ``path``, the siblings before and behind at each level.

    Rows are dealt out by ranges of source and doc_id, so a source may hold most of them. Inner nodes,
    a fifteenth of the rows, jump to the root in a logarithmic number of joins; the leaves take over
    their parent's segments at last, at most RUN of them each.

    A null source is a source of its own, and comes first; null ids come first in their source and are
    not tampered with by an id's rule. Rows with the same source and doc_id are ordered by leaf. Null
    and empty texts differ. A single row is its own subroot and root, with an empty proof. No rows
    give no rows; columns besides ``fields`` are ignored, whatever their names.
    """
    column = {f: F.col(f) for f in fields}
    altered = digest(*[encoded(lower_ascii(c) if f == "text" else c) for f, c in column.items()])
    if tampered is None:
        tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    with Scratch(docs.sparkSession, "merkle") as scratch:
        leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest(*[encoded(c) for c in column.values()]).alias("leaf"), F.when(tampered, altered).alias("altered"))
        leaves = scratch.write(ranked(scratch.write(leaves), scratch, ("source",), ("doc_id", "leaf")).withColumnRenamed("start", "tree").drop("source"))
        bottom = leaves.select("tree", "pos", "size", F.col("leaf").alias("digest"))
        levels = _levels(bottom, scratch)
        roots = bottom.where("size = 1")
        for level in levels:
            roots = roots.unionByName(level.where("size = 1").select("tree", "pos", "size", "digest"))
        tops = scratch.write(ranked(roots.select("tree", "digest"), scratch, (), ("tree",)).select("tree", "digest", "pos", "size"))
        over = _levels(tops.withColumn("tree", F.lit(TOP).cast("long")), scratch)
        # One row: a run of the top tree, or the only source's root.
        root = (over[-1] if over else tops).select("digest").first()
        here = leaves.withColumn("height", F.lit(0))
        if levels or over:
            nodes = levels[0] if levels else over[0]
            for level in [*levels[1:], *(over if levels else over[1:])]:
                nodes = nodes.unionByName(level)
            paths = _jumped(nodes, tops, scratch)
            low = nodes.where("height = 1").select(_key(F.col("tree"), F.col("height"), F.col("pos")).alias("parent"), "children").join(paths.withColumnRenamed("node", "parent"), "parent")
            joined = _parents(here, tops).join(low, "parent", "left")
            path = F.when(F.col("parent").isNull(), F.array()).otherwise(F.concat(F.array(_segment("children", "slot")), "segment"))
            subroot = F.when(F.col("size") == 1, F.col("leaf")).otherwise(F.col("subroot"))
        else:
            joined, path, subroot = here, F.array(), F.col("leaf")
        found = joined.select("doc_id", "leaf", subroot.alias("subroot"), F.lit(root[0] if root else None).cast("string").alias("root"), path.cast("array<struct<before:string,behind:string>>").alias("path"), F.coalesce("altered", "leaf").alias("given"))
        siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["behind"])), "")
        folded = F.aggregate("path", F.col("given"), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["behind"]), 256))
        out = found.select("*", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
        return scratch.keep(out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["path"] if keep_paths else [])))
