"""Issues of a whole site, from facts that are counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the preview profile.
MAX_URLS, MAX_DEEP, MAX_NOTES = 1200, 40, 25


def site_issues(facts: DataFrame, failed: DataFrame, profile: str = "full", max_pages: int | None = 500, notes: DataFrame | None = None) -> DataFrame:
    """(site, ord, severity, code, message).

    ``facts(site, from_robots, input_mode, n_entries, n_loaded, dropped, blocked)``: entries before
    cap and dedupe, pages dropped by dedupe, and pages that robots block. ``failed(site,
    sitemap_url, depth, bfs_pos)`` are files that couldn't be loaded; ``notes(site,
    depth, bfs_pos, kind, message)`` are the notes on the preview's sitemaps.
    """
    preview = profile == "preview"
    n, loaded = F.col("n_entries"), F.col("n_loaded")
    blocked = F.coalesce("blocked", F.lit(0))
    dropped = F.coalesce("dropped", F.lit(0))
    first = (
        (~F.col("from_robots") & (F.col("input_mode") == "site"), "notice", "ROBOTS_NO_USABLE_SITEMAP_REFERENCE", F.lit("robots.txt did not expose a usable XML Sitemap directive; common sitemap paths and host variants were tried."))
        if preview
        else (~F.col("from_robots"), "notice", "ROBOTS_NO_SITEMAP_REFERENCE", F.lit("robots.txt did not expose a Sitemap: entry; tried /sitemap.xml fallback."))
    )
    unusable = "Sitemap references were found, but no usable URL entries could be extracted." if preview else "Sitemap files loaded, but no usable same-host URL entries were extracted."
    checks = [
        (0, *first),
        (1, (n == 0) & (loaded > 0), "error", "SITEMAPS_FOUND_BUT_UNUSABLE", F.lit(unusable)),
        (2, (n == 0) & (loaded == 0), "error", "NO_ACCESSIBLE_SITEMAP", F.lit("No accessible XML sitemap could be loaded.")),
        (3, n == 1, "warning", "SINGLE_URL_SITEMAP", F.lit("Only 1 URL was found in the sitemap inventory. This is thin unless the site is intentionally one page.")),
        (4, n.between(2, 4), "warning", "THIN_SITEMAP", F.format_string("Only %d URLs were found in the sitemap inventory.", n)),
    ]
    if preview:
        checks += [
            (5, n >= MAX_URLS, "notice", "URL_INDEX_LIMIT_REACHED", F.lit("The preview indexed the first 1,200 URLs. Use the full profile for a complete export.")),
            (6, n > MAX_DEEP, "notice", "DEEP_CHECK_LIMIT_REACHED", F.lit("The preview deep checked 40 pages and kept the rest as index-only rows.")),
        ]
    else:
        if max_pages is not None:
            checks.append((1_000_001, n > max_pages, "warning", "MAX_PAGES_LIMIT_REACHED", F.format_string(f"Checked first {max_pages} pages out of %d.", n)))
        checks.append((1_000_002, dropped > 0, "notice", "DUPLICATE_URLS_DEDUPED", F.format_string("%d duplicate-ish sitemap URLs were collapsed in the public index.", dropped)))
    checks.append((1_000_004, blocked > 0, "warning", "ROBOTS_SITEMAP_CONFLICTS", F.format_string("%d sitemap URL(s) are advertised in the sitemap but disallowed by robots.txt.", blocked)))
    made = [
        F.when(cond, F.struct(F.lit(i).alias("ord"), F.lit(sev).alias("severity"), F.lit(code).alias("code"), message.alias("message"))) for i, cond, sev, code, message in checks
    ]
    out = facts.select("site", F.inline(F.array_compact(F.array(*made))))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("depth", "bfs_pos", "sitemap_url"))
    files = failed.withColumn("n", rank)
    if preview:
        files = files.where(F.col("n") <= MAX_NOTES)
    out = out.unionByName(
        files.select("site", (F.col("n") + 10).alias("ord"), F.lit("warning" if preview else "error").alias("severity"), F.lit("SITEMAP_FETCH_FAILED").alias("code"), F.concat(F.lit("Could not load sitemap: "), "sitemap_url").alias("message"))
    )
    if preview and notes is not None:
        told = notes.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("depth", "bfs_pos", "kind"))).where(F.col("n") <= MAX_NOTES)
        out = out.unionByName(told.select("site", (F.col("n") + 1000).alias("ord"), F.lit("notice").alias("severity"), F.lit("DISCOVERY_NOTE").alias("code"), "message"))
    return out
