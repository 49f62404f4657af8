"""Embedding whitening: scatter and projection by distributed block matrices, eigenvectors on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked

#: Components that are returned, and rows and columns of a block.
COMPONENTS, BLOCK_ROWS, BLOCK_COLS = 16, 1_024, 1_024
#: Rows that one block matrix holds: Spark numbers its blocks on the driver and its rows by 32-bit
#: integers, so longer tables are taken in slabs, whose scatters add up.
SLAB_ROWS = 1 << 24
#: Entries become whole numbers, SCALE times as large and moved by OFFSET; beyond LARGEST they count as that.
SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 62)
#: A component whose eigenvalue is below this share of the largest has no direction to speak of.
NOISE = 1e-11


def quantised(vector: Column) -> Column:
    """The vector's entries as longs; null for a vector that is null or holds a null or non-finite entry."""
    c = F.transform(vector, lambda v: v.cast("double"))
    sound = ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & sound, F.transform(c, lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long") + OFFSET))


class Shift:
    """Exact sums of a list of vectors: n of them, and per dimension the whole part and the rest of the mean."""

    def __init__(self, rows: DataFrame):
        parts = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.shiftright("v", 32)).alias("hi"), F.sum(F.col("v").bitwiseAND(0xFFFFFFFF)).alias("lo"))
        found = sorted((r["i"], r["n"], (r["hi"] << 32) + r["lo"]) for r in parts.collect())
        self.n = found[0][1] if found else 0
        self.whole = [s // self.n for _, _, s in found]
        self.rest = [s % self.n for _, _, s in found]

    def centred(self) -> Column:
        """x - S/n in double precision."""
        whole, rest = F.lit(self.whole), F.lit([r / self.n for r in self.rest])
        return F.transform("x", lambda v, i: (v - whole[i]).cast("double") - rest[i])

    def deviation(self) -> Column:
        """Sum of (n x - S)^2, exact; null where a long does not hold it."""
        whole, rest, n = F.lit(self.whole), F.lit(self.rest), F.lit(self.n)
        scaled = F.transform("x", lambda v, i: F.try_subtract(F.try_multiply(n, F.try_subtract(v, whole[i])), rest[i]))
        return F.aggregate(scaled, F.lit(0).cast("long"), lambda acc, v: F.try_add(acc, F.try_multiply(v, v)))


def _slabs(rows: DataFrame, n: int, slab: int) -> list[DataFrame]:
    """``rows(pos, ...)`` by ranges of ``slab`` places, which start from 0 again in ``index``."""
    return [rows.where((F.col("pos") >= a) & (F.col("pos") < a + slab)).withColumn("index", F.col("pos") - a) for a in range(0, n, slab)]


def _blocks(slab: DataFrame, value: Column, n_rows: int, n_cols: int) -> BlockMatrix:
    """The block matrix with row ``index`` holding ``value``."""
    # A block needs its rows together, and products are dealt to the root of the partitions' number.
    tasks = max(1, -(-n_rows // (4 * BLOCK_ROWS)))
    even = slab.select("index", "x").repartition(tasks, "index") if tasks > 1 else slab.select("index", "x")
    vectors = MLUtils.convertVectorColumnsFromML(even.select("index", array_to_vector(value).alias("vector")))
    return IndexedRowMatrix(vectors, n_rows, n_cols).toBlockMatrix(BLOCK_ROWS, BLOCK_COLS)


def _scatter(m: BlockMatrix) -> np.ndarray:
    """Transpose times matrix. Rows are the product's middle dimension: it is split, so that no task multiplies all blocks."""
    splits = max(1, min(512, m.numRows() // BLOCK_ROWS))
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, int(splits))
    return np.asarray(BlockMatrix(product, BLOCK_COLS, BLOCK_COLS).toLocalMatrix().toArray())


def _projected(m: BlockMatrix, by: BlockMatrix) -> DataFrame:
    """(index, y) of the rows of the matrix times ``by``."""
    rows = m.multiply(by).toIndexedRowMatrix()
    frame = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(frame).select("index", vector_to_array("vector").alias("y"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, slab: int = SLAB_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every sound row of ``vectors``.

    Entries c become x = floor(SCALE * c) + OFFSET. Mean and covariance are those of the distinct
    x-vectors (n of them). Centred rows are indexed into distributed blocks; transpose times matrix
    gives the scatter, whose eigenvectors are found on the driver, and a second product projects the
    rows. The largest difference of the projected list's covariance from the identity comes with
    every row.

    Left out are rows whose vector is null or holds null or non-finite entries, and rows whose
    dimension is not the commonest (ties: the larger). Of d dimensions at most d components exist;
    one whose eigenvalue is noise, as where entries are constant or one vector is given, has null as
    ``whitened`` and does not count in ``identity_error``, which is null if none counts; ``explained``
    is null where nothing varies. Repeated rows each get their rows but count once in the fit; a null
    id is kept. ``deviation`` is null where a long cannot hold it. No sound rows give no rows; other
    columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    with Scratch(spark, "whitening") as scratch:
        sound = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("x")).where("size(x) > 0")
        lengths = sound.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dims = lengths["d"] if lengths else 1
        sound = sound.where(F.size("x") == dims)
        rows = scratch.write(ranked(sound, scratch).select("vec_id", "x", "pos"))
        fit = scratch.write(ranked(rows.select("x").distinct(), scratch).select("x", "pos"))
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        shift = Shift(fit)
        if not shift.n:
            return spark.createDataFrame([], schema)
        n_rows = rows.count()
        scatter = np.zeros((dims, dims))
        for i, part in enumerate(_slabs(fit, shift.n, slab)):
            scatter += _scatter(_blocks(part, shift.centred(), min(slab, shift.n - i * slab), dims))
        value, vector = np.linalg.eigh(scatter / shift.n)
        value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
        trace = float(np.trace(scatter)) / shift.n
        real = value > NOISE * max(float(value[0]), 0.0)
        count = len(value)
        matrix = np.where(real, vector / np.sqrt(np.where(real, value, 1.0)), 0.0)
        by = _blocks(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(matrix)], "index long, x array<double>"), F.col("x"), dims, count)

        def project(table: DataFrame, n: int) -> DataFrame:
            out = None
            for i, part in enumerate(_slabs(table, n, slab)):
                y = _projected(_blocks(part, shift.centred(), min(slab, n - i * slab), dims), by).select((F.col("index") + i * slab).alias("pos"), "y")
                out = y if out is None else out.unionByName(y)
            return scratch.write(out)

        fitted = project(fit, shift.n)
        mean = [r["m"] for r in fitted.select(F.posexplode("y").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]
        centre = F.lit(mean)
        again = np.zeros((count, count))
        centred = fitted.withColumnRenamed("y", "x")
        for i, part in enumerate(_slabs(centred, shift.n, slab)):
            again += _scatter(_blocks(part, F.transform("x", lambda v, j: v - centre[j]), min(slab, shift.n - i * slab), count))
        off = np.abs(again / shift.n - np.eye(count))[np.ix_(real, real)]
        error = float(off.max()) if off.size else None
        told = F.lit([float(v / trace) if trace > 0 else None for v in value]) if trace > 0 else F.lit(None).cast("array<double>")
        keep = F.lit([bool(b) for b in real])
        out = rows.join(project(rows, n_rows), "pos").select("vec_id", shift.deviation().alias("deviation"), F.posexplode("y").alias("i", "v"))
        return scratch.keep(
            out.select(
                "vec_id", (F.col("i") + 1).alias("component"), F.lit(shift.n).cast("long").alias("n"), "deviation", F.when(keep[F.col("i")], F.col("v")).alias("whitened"),
                told[F.col("i")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
            )
        )
