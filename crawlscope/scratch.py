"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes a side may have to be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The folder of the run that owns tables made now, if one does.
_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local session makes a
    temporary folder once; on a cluster a machine's own folder would not do, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="crawlscope-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    As a context it deletes its tables at the end, but for those that :meth:`keep` made. Kept
    results stay in the shared folder, for their frames read them whenever they are used. What is
    made inside :meth:`owning`, results too, lies in this one's folder and goes with :meth:`close`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_OWNER.get() or scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    @contextmanager
    def owning(self) -> Iterator[None]:
        token = _OWNER.set(self.root)
        try:
            yield
        finally:
            _OWNER.reset(token)

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        """``df`` as a table read back from the shared folder; the writer takes ``options``."""
        self.n += 1
        return self._written(df, f"{self.root}/{self.n}", **options)

    def keep(self, df: DataFrame) -> DataFrame:
        """As :meth:`write`, for a result: the table stays when the others go."""
        self.n += 1
        return self._written(df, f"{self.root}-result{self.n}")

    def _written(self, df: DataFrame, path: str, **options: str) -> DataFrame:
        # What is written is read from its table: the job's shuffle files are needed no longer.
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if getattr(df, "_scratch_path", None):
            self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        self._delete(self.root)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else unchanged.

    Where rows may be long, ``size`` is an expression for a row's bytes, of which ``limit`` in all
    may be broadcast.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    if size is not None and (df.agg(F.sum(F.expr(size))).first()[0] or 0) > limit:
        return df
    return F.broadcast(df)
