"""Run counters, in batch over a run log and as a stream over its growth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_counters(run_log: DataFrame) -> DataFrame:
    """(runs, pages) over all rows of ``run_log(discovered_url_count)``; zeros where there are none."""
    return run_log.agg(F.count("*").alias("runs"), F.coalesce(F.sum("discovered_url_count"), F.lit(0)).cast("long").alias("pages"))


def stream_run_counters(run_log: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the counters of a streaming ``run_log`` as a table at ``path``, one row, replaced as the log grows."""

    def replace(counters: DataFrame, _: int) -> None:
        counters.write.mode("overwrite").parquet(path)

    return run_counters(run_log).writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).start()
