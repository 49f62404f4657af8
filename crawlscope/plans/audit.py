"""The whole audit: from sites and a fetch log to pages, issues, scores and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import checks, crosspage, redirects, robots, scores, sitemaps
from ..operators import site_issues as site_level
from ..scratch import Scratch
from ..sources.fetch_log import fetch_log_of, followed


@dataclass(frozen=True)
class AuditConfig:
    """Profile ``full`` or ``preview``, and its bounds; None for no bound.

    ``collation`` orders URLs where a bound or a tie takes the first of them: None by code point,
    ``UNICODE`` as web scripts compare texts. With ``ascii_hosts`` both spellings of an
    internationalised host are one. A full run without ``max_pages`` notes sites of more than
    ``noted_pages`` entries as that bound would, though all their pages are checked.
    """

    profile: str = "full"
    max_pages: int | None = 500
    max_hops: int = 10
    max_depth: int = 50
    max_files: int | None = None
    max_urls: int | None = None
    max_deep: int = checks.MAX_DEEP
    collation: str | None = None
    ascii_hosts: bool = False
    noted_pages: int | None = None


#: The preview with the bounds of an interactive run.
PREVIEW = AuditConfig(profile="preview", max_pages=None, max_hops=8, max_files=35, max_urls=1200)


@dataclass(frozen=True)
class Audit:
    """Named frames of a finished run, keyed by ``site``; pages and issues are written tables.

    The frames read the run's folder, which :meth:`close`, or the end of a ``with`` block, deletes.
    """

    files: DataFrame
    entries: DataFrame
    pages: DataFrame
    page_issues: DataFrame
    site_issues: DataFrame
    stats: DataFrame
    scores: DataFrame
    report: DataFrame
    scratch: Scratch

    def close(self) -> None:
        self.scratch.close()

    def __enter__(self) -> Audit:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def run_audit(sites: DataFrame, fetch_log: DataFrame, config: AuditConfig = AuditConfig()) -> Audit:
    """Audit every site of ``sites(site)`` over the documents of ``fetch_log``.

    In the preview profile the output's ``site`` is the chosen host variant. All joins are on
    site or URL; bodies leave the plan as soon as their metadata is extracted. A run that fails leaves
    no tables.
    """
    scratch = Scratch(sites.sparkSession, "audit")
    try:
        with scratch.owning(), U.ascii_hosts(config.ascii_hosts):
            return _run(sites, fetch_log, config, scratch)
    except BaseException:
        scratch.close()
        raise


def _run(sites: DataFrame, fetch_log: DataFrame, config: AuditConfig, scratch: Scratch) -> Audit:
    preview = config.profile == "preview"
    log = fetch_log_of(fetch_log)
    named = sites.select(F.col("site").alias("input"), U.norm_site(F.col("site")).alias("norm")).where("norm IS NOT NULL").dropDuplicates(["norm"])
    direct = U.input_mode(F.col("input")) == "sitemap"
    targets = named.select(F.when(direct, U.norm_url(F.col("norm"))).otherwise(F.col("norm")).alias("site")) if preview else named.select(F.col("norm").alias("site"))
    wanted = log.where(U.is_sitemap_url(F.col("url")) | F.lower(U.path(F.col("url"))).endswith("/robots.txt")).select(F.col("url").alias("start_url"))
    docs = scratch.write(followed(redirects.resolve_redirects(wanted, log, config.max_hops)))

    bases = targets.where(U.input_mode(F.col("site")) == "site").select("site", F.explode(U.host_variants(F.col("site"))).alias("base")) if preview else targets.select("site", F.col("site").alias("base"))
    answered = F.col("error").isNull() if preview else F.col("ok")
    texts = (
        bases.select("base").distinct()
        .withColumn("url", F.concat(U.origin(F.col("base")), F.lit("/robots.txt")))
        .join(docs.where(answered).hint("merge"), "url")
        .select(F.col("base").alias("site"), "body")
    )
    robots_txt = scratch.write(texts)
    groups, rules, _ = robots.robots_rules(robots_txt)
    directives = robots.sitemap_directives(robots_txt)
    seeds = scratch.write(sitemaps.seed_sitemaps(targets, directives, config.profile))
    start = seeds.select(F.col("base").alias("site"), "sitemap_url", "pos").distinct()
    files = scratch.write(sitemaps.expand_sitemaps(start, docs, config.profile, config.max_depth, config.max_files, config.max_urls))
    every = scratch.write(sitemaps.sitemap_entries(files, docs, config.profile))

    counts = (
        seeds.groupBy(F.col("site").alias("input"), "cand_pos", F.col("base").alias("site")).agg(F.max("from_robots").alias("from_robots"))
        .withColumn("input_mode", U.input_mode(F.col("input")) if preview else F.lit("site"))
        .join(every.groupBy("site").agg(F.count("*").alias("n_entries")), "site", "left")
        .join(files.groupBy("site").agg(F.count_if("loaded").alias("n_loaded"), F.count_if(~F.col("loaded")).alias("n_failed")), "site", "left")
        .na.fill(0, ["n_entries", "n_loaded", "n_failed"])
    )
    if preview:
        counts = sitemaps.choose_candidate(counts.withColumnsRenamed({"site": "base", "input": "site"})).withColumnsRenamed({"site": "input", "base": "site"})
    counts = scratch.write(counts)
    own = counts.select("site")
    entries = every.join(own, "site", "left_semi")
    site_files = files.join(own, "site", "left_semi")
    if preview:
        no_rules = counts.where("input_mode = 'sitemap'").select("site")
        groups = groups.join(no_rules, "site", "left_anti")
        entries = checks.deep_sample(entries, config.max_deep, config.collation)
        deep_entries = entries.where("deep_checked")
    else:
        deep_entries = entries if config.max_pages is None else sitemaps.cap_pages(entries, config.max_pages, config.collation)
    fetched = redirects.resolve_redirects(deep_entries.select(F.col("url").alias("start_url")), log, config.max_hops).withColumnRenamed("start_url", "url")
    meta = checks.extract_metadata(fetched, profile=config.profile)
    checked = checks.check_pages(deep_entries.join(meta, "url", "left"), config.profile)
    if preview:
        rest = checks.index_only(entries.where("NOT deep_checked"))
        pages = checked.withColumn("deep_checked", F.lit(True)).unionByName(rest.withColumn("deep_checked", F.lit(False)), allowMissingColumns=True)
        pages = scratch.write(pages)
        dropped = None
        sharing = pages.where("deep_checked")
    else:
        inspected = scratch.write(checked.withColumn("deep_checked", F.lit(True)))
        kept, dropped = crosspage.dedupe_pages(inspected, config.collation)
        pages = scratch.write(kept)
        sharing = pages
    conflicts, blocked = robots.robots_conflicts(pages, groups, rules)
    issues = scratch.write(
        crosspage.merge_issues(
            checks.page_issues(pages),
            crosspage.duplicate_titles(sharing, config.profile),
            crosspage.duplicate_descriptions(sharing),
            conflicts,
        )
    )
    facts = counts.join(blocked, "site", "left")
    facts = facts.join(dropped, "site", "left") if dropped is not None else facts.withColumn("dropped", F.lit(0))
    notes = scratch.write(sitemaps.sitemap_notes(site_files, docs)) if preview else None
    noted = config.noted_pages if config.max_pages is None else config.max_pages
    root = scratch.write(site_level.site_issues(facts, sitemaps.failed_sitemaps(site_files), config.profile, noted, notes))
    pages = pages.drop("issues")
    stats = scores.site_stats(own, pages, issues, root)
    scored = scores.site_scores(own, pages, issues, root, config.profile)
    errors = issues.where("severity = 'error'").select("site", "url").distinct().groupBy("site").agg(F.count("*").alias("deep_errors"))
    deep = pages.groupBy("site").agg(F.count_if("deep_checked").alias("n_deep"))
    verdict = scores.site_verdict(counts.withColumn("host", U.url_host(F.col("site"))).join(errors, "site", "left").join(deep, "site", "left").na.fill(0))
    sources = source_of(seeds.join(own.withColumnRenamed("site", "base"), "base", "left_semi"), site_files)
    if preview:
        chosen = counts.select("site", "input_mode", "from_robots").distinct()
        sources = sources.join(scratch.write(sitemaps.source_diagnostics(chosen, docs, directives, site_files, notes)), "site", "left")
    report = stats.join(scored, "site").join(verdict, "site").join(sources, "site").join(counts.select("site", "n_entries", "input_mode"), "site").join(deep, "site", "left").na.fill(0)
    return Audit(site_files, entries, pages, issues, root, stats, scored, report, scratch)


def source_of(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """(site, robots_url, sitemap_urls, from_robots): loaded files in visiting order, else those tried."""
    tried = seeds.groupBy(F.col("base").alias("site")).agg(F.array_sort(F.collect_list(F.struct("pos", "sitemap_url"))).alias("tried"), F.max("from_robots").alias("from_robots"))
    loaded = files.where("loaded").groupBy("site").agg(F.array_sort(F.collect_list(F.struct("depth", "bfs_pos", "sitemap_url"))).alias("loaded"))
    return tried.join(loaded, "site", "left").select(
        "site",
        F.concat(U.origin(F.col("site")), F.lit("/robots.txt")).alias("robots_url"),
        F.coalesce(F.col("loaded.sitemap_url"), F.col("tried.sitemap_url")).alias("sitemap_urls"),
        "from_robots",
    )
