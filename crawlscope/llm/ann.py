"""Approximate nearest neighbours: inverted lists scanned with adaptive dimension tests."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bound on the rows that lists and rotation are fitted on, those with the smallest hashes.
SAMPLE = 16_384
#: Largest number of lists; below it the number is half the root of the rows.
MAX_LISTS = 1_024
#: Share of the nearest sampled rows, of so many sampled queries, that the probed lists must hold.
TARGET, TRIALS = 0.97, 256
#: Rows and queries that meet in one task: larger lists are dealt out in blocks.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024
#: Dimensions added between two tests, and the test's width in standard deviations.
STEP, WIDTH = 16, 3.0


@dataclass(frozen=True)
class Index:
    """What every task needs: the norm bound, rotation, list centres, and how many lists to probe."""

    top: float
    rotation: np.ndarray
    centres: np.ndarray
    probes: int = 1

    def place(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rotated vectors with one more dimension, in which inner products order as distances do.

        The added coordinate makes all rows equally long; that of a query is zero.
        """
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", x, x), 0))
        return (np.column_stack([x, more]) @ self.rotation).astype(np.float32)

    def to_centres(self, y: np.ndarray) -> np.ndarray:
        return np.square(self.centres).sum(axis=1) - 2 * (y @ self.centres.T)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors in double precision)."""
    ok, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is None or len(v) != dim or any(c is None for c in v):
            continue
        a = np.asarray(v, dtype=np.float64)
        if np.isfinite(a).all() and a.any():
            ok.append(i), rows.append(a)
    return np.array(ok, dtype=np.int64), np.array(rows, dtype=np.float64).reshape(-1, dim)


def _valid(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = _matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.einsum("ij,ij->i", x, x), pa.float64())],
                names=["vec_id", "vector", "square"],
            )

    return run


def _stack(column, dtype) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=dtype).reshape(len(parts), -1)


def _lists(index, probes: int, query: bool):
    """(vec_id, vector, list): the nearest list of a row, or the lists that a query probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            d = ix.to_centres(ix.place(_stack(batch.column(1), np.float64), query))
            n = min(probes, d.shape[1])
            near = np.argpartition(d, n - 1, axis=1)[:, :n]
            at = np.repeat(np.arange(len(d)), n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(near.ravel(), pa.int32())], names=["vec_id", "vector", "list"])

    return run


def scan(q: np.ndarray, x: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each query the rows of ``x`` that may be among its ``k`` nearest by distance.

    Distances grow by STEP rotated dimensions at a time. After a random rotation the share of a
    squared distance that lies in d of D dimensions is Beta(d / 2, (D - d) / 2); a row is abandoned
    as soon as its partial distance is more than WIDTH standard deviations above that share of the
    k-th distance known so far.
    """
    dims = x.shape[1]
    cuts = [*range(0, dims, STEP), dims]
    blocks = [(x[:, a:b], q[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    first = np.square(blocks[0][0]).sum(axis=1) + np.square(blocks[0][1]).sum(axis=1)[:, None] - 2 * (blocks[0][1] @ blocks[0][0].T)
    for i in range(len(q)):
        part = first[i]
        if len(part) <= k:
            yield np.arange(len(part))
            continue
        seed = np.argpartition(part, k - 1)[:k]
        bound = float(np.square(x[seed] - q[i]).sum(axis=1).max())
        alive = np.arange(len(part))
        for (xb, qb), seen in zip([*blocks[1:], (None, None)], cuts[1:], strict=True):
            slack = 1e-4 * (1 + abs(bound))
            share = seen / dims + WIDTH * np.sqrt(2 * seen * (dims - seen) / (dims**2 * (dims + 2)))
            allowed = bound * min(1.0, share)
            stay = part <= allowed + slack
            alive, part = alive[stay], part[stay]
            if xb is not None:
                part = part + np.square(xb[alive] - qb[i]).sum(axis=1)
        yield alive


def _search(index, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ix = index.value
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, qids = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        vx, vq = _stack(rows["vector"], np.float64), _stack(queries["vector"], np.float64)
        out = []
        # One more than asked for, since the query's own row may be among them, or more if ids repeat.
        want = k * int(np.unique(ids, return_counts=True)[1].max()) + 1
        for i, alive in enumerate(scan(ix.place(vq, True), ix.place(vx, False), want)):
            alive = alive[ids[alive] != qids[i]]
            s = np.einsum("ij,j->i", vx[alive], vq[i])
            best = np.lexsort((ids[alive], -s))[:k]
            out.append(pa.table([pa.array(np.full(len(best), qids[i])), pa.array(ids[alive][best]), pa.array(s[best])], schema=schema))
        return pa.concat_tables(out)

    return run


def _to_lists(y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(np.square(centres).sum(axis=1) - 2 * (y[a : a + 2048] @ centres.T)).argmin(axis=1) for a in range(0, len(y), 2048)])


def fit(vectors: DataFrame, dim: int, k: int, sample: int = SAMPLE, target: float = TARGET, seed: int = 7) -> Index:
    """Rotation, centres and probes from at most ``sample`` rows of ``vectors(vec_id, vector, square)``.

    The probes are the fewest lists that hold ``target`` of the ``k`` nearest sampled rows of up to
    TRIALS sampled rows: few where the vectors form clusters, many where they don't.
    """
    n, top = vectors.agg(F.count("*"), F.max("square")).first()
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0]
    raw = Index(float(top or 0), rotation, np.zeros((1, dim + 1), dtype=np.float32))
    if not n:
        return raw
    some = _stack(vectors.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()["vector"], np.float64)
    some = np.unique(some, axis=0)
    y = raw.place(some, False)
    lists = max(1, min(MAX_LISTS, int(np.sqrt(n) / 2), len(y) // 16))
    centres = y[rng.permutation(len(y))[:lists]]
    for _ in range(8):
        near = _to_lists(y, centres)
        total = np.zeros(centres.shape)
        np.add.at(total, near, y)
        count = np.bincount(near, minlength=lists)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres).astype(np.float32)
    made = Index(raw.top, rotation, centres)
    near = _to_lists(y, centres)
    trial = rng.permutation(len(some))[:TRIALS]
    score = some[trial] @ some.T
    score[np.arange(len(trial)), trial] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, max(1, len(some) - 1))]
    order = np.argsort(np.argsort(made.to_centres(made.place(some[trial], True)), axis=1), axis=1)
    turn = np.sort(np.take_along_axis(order, near[best], axis=1).ravel())
    return Index(raw.top, rotation, centres, int(turn[min(len(turn) - 1, int(np.ceil(target * len(turn))))]) + 1)


def nearest(vectors: DataFrame, k: int = 20, is_query=None, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """The ``k`` nearest rows by inner product for each query: (query_id, rank, vec_id, score).

    Queries are the rows that satisfy ``is_query`` (a column of ``id_col``; default ids divisible by
    20); candidates are all rows but those with the query's own id. Every row is indexed in the list
    of its nearest centre, and a query scans the lists nearest to it (see :func:`fit`); scores are exact, in double
    precision. A query that finds fewer than ``k`` in its lists scans all of them.

    Lists are dealt out in blocks of about BLOCK_ROWS rows and BLOCK_QUERIES queries, by hashes of
    their ids, so that one popular vector fills many tasks rather than one. Ties go to the smaller
    vec_id. Vectors that are null, zero, of another dimension than most, or hold null or non-finite
    components take no part, nor do null ids. A row that repeats an id counts once, with its best
    score. No rows give no rows. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    common = raw.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["n"]
    with Scratch(spark, "nearest") as scratch:
        rows = scratch.write(raw.mapInArrow(_valid(dim), "vec_id long, vector binary, square double"))
        fitted = fit(rows, dim, k, target=target)
        index = spark.sparkContext.broadcast(fitted)
        n_lists = len(fitted.centres)
        probes = fitted.probes
        queries = rows.where(F.col("vec_id") % 20 == 0 if is_query is None else is_query)
        kind = "vec_id long, vector binary, list int"
        listed = scratch.write(rows.select("vec_id", "vector").mapInArrow(_lists(index, 1, False), kind))

        def found(some: DataFrame, n_probes: int) -> DataFrame:
            asked = scratch.write(some.select("vec_id", "vector").mapInArrow(_lists(index, n_probes, True), kind))
            # At most MAX_LISTS rows: how many blocks each list and its queries are dealt to.
            deal = F.broadcast(
                listed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).join(
                    asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("turns")), "list"
                )
            )
            row_block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block")
            turn = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("turns")).cast("int").alias("turn")
            every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
            left = listed.join(deal, "list").select("list", row_block, every("turns").alias("turn"), "vec_id", "vector")
            right = asked.join(deal, "list").select("list", every("blocks").alias("block"), turn, "vec_id", "vector")
            keys = ["list", "block", "turn"]
            hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(index, k), "query_id long, vec_id long, score double")
            best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            return scratch.write(once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

        out = found(queries, probes)
        total = rows.select("vec_id").distinct().count()
        full = min(k, total - 1)
        short = queries.join(out.where(F.col("rank") == full).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti") if full > 0 else queries.limit(0)
        if probes < n_lists and not short.isEmpty():
            again = found(short, n_lists)
            out = out.join(again.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(again)
        return scratch.keep(out)
