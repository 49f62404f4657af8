"""Redirect chains, loops and limits over the fetch log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..scratch import Scratch

HOP = "array<struct<url:string,status:int,location:string>>"


def redirect_hops(fetch_log: DataFrame) -> DataFrame:
    """(url, status, next) of the redirects: 3xx with a Location, resolved against the URL.

    Of several redirects of one URL the smallest Location counts, then the smallest status.
    """
    location = F.coalesce("location", F.lit(""))
    stated = fetch_log.where(F.col("status").between(300, 399) & (location != "") & F.col("error").isNull())
    hop = stated.groupBy("url").agg(F.min(F.struct("location", "status")).alias("hop")).select("url", "hop.*")
    return hop.select("url", "status", F.coalesce(U.resolve_url(F.col("location"), F.col("url")), F.col("location")).alias("next"))


def redirect_paths(hops: DataFrame, max_hops: int, scratch: Scratch) -> DataFrame:
    """(url, chain) of the first ``max_hops + 1`` hops from each URL of ``hops(url, status, next)``, loops walked on.

    Each round appends to every chain that of the URL where it ends, which doubles their length, so
    rounds grow with the logarithm of the limit and end earlier when no chain grows. The rows are
    narrow, one for each redirect.
    """
    one = F.struct("url", "status", F.col("next").alias("location"))
    paths = scratch.write(hops.select("url", F.array(one).cast(HOP).alias("chain"), F.col("next").alias("to")))
    for _ in range(max_hops.bit_length()):
        onward = paths.select(F.col("url").alias("to"), F.col("chain").alias("rest"), F.col("to").alias("end"))
        longer = F.slice(F.concat("chain", F.coalesce("rest", F.array().cast(HOP))), 1, max_hops + 1)
        grown = scratch.write(paths.join(onward, "to", "left").select("url", longer.alias("chain"), F.coalesce("end", "to").alias("to"), F.col("rest").isNotNull().alias("grew")))
        scratch.drop(paths)
        paths = grown
        if paths.where("grew").isEmpty():
            break
    return paths.select("url", "chain")


def resolve_redirects(start_urls: DataFrame, fetch_log: DataFrame, max_hops: int = 10) -> DataFrame:
    """Where each of ``start_urls(start_url)`` ends: (start_url, status, final_url, body, content_type,
    chain, n_hops, loop, truncated, error).

    Hops are followed one after another; a hop to a URL visited before the current one is a loop and
    ends the chain with the hop's status, and more than ``max_hops`` hops end it with status 310. A
    chain that reaches a URL that isn't in the log or failed has nulls throughout and no hops. Where the
    log has a URL more than once, a hop is :func:`redirect_hops`' and an end the row of the largest
    status, then of the largest final URL, content type, body and error.

    The chains of all redirects come from :func:`redirect_paths`; a start takes its own, and what ends
    it is decided within the row. Bodies are joined once, at the end.
    """
    scratch = Scratch(start_urls.sparkSession, "redirects")
    paths = redirect_paths(redirect_hops(fetch_log), max_hops, scratch)
    none = F.array().cast(HOP)
    starts = start_urls.select("start_url").where("start_url IS NOT NULL").distinct()
    walks = starts.join(paths.withColumnRenamed("url", "start_url"), "start_url", "left").withColumn("chain", F.coalesce("chain", none))
    back = F.filter(F.sequence(F.lit(1), F.size("chain")), lambda i: F.array_contains(F.slice(F.col("chain.url"), F.lit(1), i - 1), F.get(F.col("chain"), i - 1)["location"]))
    walks = walks.withColumn("loop_at", F.when(F.size("chain") > 0, F.get(back, F.lit(0))))
    walks = walks.withColumn("kind", F.when(F.col("loop_at").isNotNull(), "loop").when(F.size("chain") > max_hops, "limit").otherwise("end"))
    walks = walks.withColumn("chain", F.when(F.col("loop_at").isNotNull(), F.slice("chain", F.lit(1), F.col("loop_at"))).otherwise(F.col("chain")))
    hop = F.try_element_at("chain", F.lit(-1))
    walked = walks.select("start_url", F.coalesce(hop["location"], "start_url").alias("cur"), "chain", "kind", F.when(F.col("kind") == "limit", 310).otherwise(hop["status"]).alias("last_status"))
    row = F.max(F.struct("status", "final_url", "content_type", "body", "error"))
    last = fetch_log.groupBy(F.col("url").alias("cur")).agg(row.alias("row")).select("cur", "row.*")
    out = walked.join(last, "cur", "left")
    at_end = F.col("kind") == "end"
    broken = at_end & (F.col("status").isNull() | F.col("error").isNotNull())
    chain = F.when(broken, none).otherwise(F.col("chain"))
    return out.select(
        "start_url",
        F.when(~at_end, F.col("last_status")).when(~broken, F.col("status")).alias("status"),
        F.when(~at_end, F.col("cur")).when(~broken, F.coalesce("final_url", "cur")).alias("final_url"),
        F.when(~at_end, "").when(~broken, F.col("body")).alias("body"),
        F.when(at_end & ~broken, F.col("content_type")).alias("content_type"),
        chain.alias("chain"),
        F.size(chain).alias("n_hops"),
        (F.col("kind") == "loop").alias("loop"),
        (F.col("kind") == "limit").alias("truncated"),
        F.when(broken, F.coalesce("error", F.lit("not in the fetch log"))).alias("error"),
    )
