"""The fetch log: one row per URL requested, redirects not followed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "url string, status int, location string, final_url string, content_type string, body string, error string"


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A fetch log from files; the schema is given, so that unread columns are never read."""
    return spark.read.schema(SCHEMA).format(fmt).load(path)


def fetch_log_of(df: DataFrame) -> DataFrame:
    """``df`` with the columns of a fetch log; missing ones are null, bodies of redirects empty."""
    for field in SCHEMA.split(", "):
        name, kind = field.split(" ")
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    redirect = F.col("status").between(300, 399) & (F.coalesce("location", F.lit("")) != "")
    return df.select(
        "url",
        F.col("status").cast("int").alias("status"),
        "location",
        F.coalesce("final_url", "url").alias("final_url"),
        "content_type",
        F.when(redirect, "").otherwise(F.col("body")).alias("body"),
        "error",
    )


def followed(resolved: DataFrame) -> DataFrame:
    """Documents after redirects: (url, status, ok, body, content_type, error) of ``resolved_fetch``.

    ``ok`` is a status of 2xx. A loop or a chain over the limit is an error, as when a client that
    follows redirects gives up.
    """
    failed = F.col("status").isNull() | F.col("loop") | F.col("truncated")
    return resolved.select(
        F.col("start_url").alias("url"),
        F.when(~failed, F.col("status")).alias("status"),
        (~failed & F.col("status").between(200, 299)).alias("ok"),
        F.when(~failed, F.coalesce("body", F.lit(""))).alias("body"),
        "content_type",
        F.when(failed, F.coalesce("error", F.lit("fetch failed"))).alias("error"),
    )
