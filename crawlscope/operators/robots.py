"""Robots rules: parsing, sitemap directives, verdicts and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..scratch import Scratch, small


def _lines(robots: DataFrame) -> DataFrame:
    """(site, pos, raw) of the lines of ``robots(site, body)``."""
    return robots.select("site", F.posexplode(F.split(F.col("body"), r"\r?\n")).alias("pos", "raw"))


def _fields(robots: DataFrame) -> DataFrame:
    """(site, pos, field, value) of the lines with a colon, comments stripped."""
    line = T.trim(F.regexp_replace("raw", r"#.*\z", ""))
    return (
        _lines(robots)
        .select("site", "pos", line.alias("line"))
        .where(F.contains("line", F.lit(":")))
        .select(
            "site",
            "pos",
            F.lower(T.trim(F.regexp_extract("line", r"(?s)\A([^:]*):", 1))).alias("field"),
            T.trim(F.regexp_extract("line", r"(?s)\A[^:]*:(.*)\z", 1)).alias("value"),
        )
    )


def pattern_regex(pattern: Column) -> Column:
    """Rule pattern as an expression: anchored at the start, ``*`` any run, a final ``$`` the end."""
    end = pattern.endswith("$")
    body = F.when(end, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(end, r"\z").otherwise(""))


def robots_rules(robots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups (site, ua), rules (site, ua, rule_pos, allow, pattern, len, regex) and sitemap lines
    (site, pos, sitemap_url) of ``robots(site, body)``.

    Consecutive user-agent lines share the rules that follow; a user-agent line after a rule begins
    a new group; groups of one agent merge. An empty value is no rule but ends the agents' lines all
    the same; other fields are passed over.
    """
    fields = _fields(robots)
    told = fields.where(F.col("field").isin("user-agent", "allow", "disallow"))
    is_agent = F.col("field") == "user-agent"
    order = Window.partitionBy("site").orderBy("pos")
    before = F.lag(is_agent).over(order)
    blocks = told.withColumn("opens", (is_agent & ~F.coalesce(before, F.lit(False))).cast("int")).withColumn("block", F.sum("opens").over(order))
    agents = blocks.where(is_agent).select("site", "block", F.lower("value").alias("ua")).distinct()
    rules = (
        blocks.where(~is_agent & (F.col("value") != ""))
        .select("site", "block", F.col("pos").alias("rule_pos"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
        .join(agents, ["site", "block"])
        .select("site", "ua", "rule_pos", "allow", "pattern", T.utf16_length(F.col("pattern")).alias("len"), pattern_regex(F.col("pattern")).alias("regex"))
    )
    maps = fields.where((F.col("field") == "sitemap") & (F.col("value") != "")).select("site", "pos", F.col("value").alias("sitemap_url"))
    return agents.select("site", "ua").distinct(), rules, maps


def sitemap_directives(robots: DataFrame) -> DataFrame:
    """(site, pos, sitemap_url, usable) of the ``Sitemap:`` lines; comments are not stripped here.

    ``usable`` values look like XML sitemaps; the others are the ignored directives.
    """
    line = T.trim(F.col("raw"))
    value = T.trim(F.regexp_replace(line, rf"(?i)\Asitemap{T.SPACE}*:", ""))
    return (
        _lines(robots)
        .where(line.rlike(rf"(?i)\Asitemap{T.SPACE}*:"))
        .select("site", "pos", value.alias("sitemap_url"))
        .where("sitemap_url <> ''")
        .withColumn("usable", U.is_sitemap_url(F.col("sitemap_url")))
    )


#: Rules of a site that are tried on each of its URLs; a site with more has them looked up by their beginnings.
TRIED_RULES = 64


def _chosen(groups: DataFrame, rules: DataFrame, user_agent: str) -> DataFrame:
    """``rules`` of the groups that hold for an agent: its own or else those of ``*``.

    A group that is there but empty does not fall back.
    """
    ua = user_agent.lower()
    chosen = groups.where(F.col("ua").isin(ua, "*")).groupBy("site").agg(F.max_by("ua", F.col("ua") == ua).alias("ua"))
    return rules.join(chosen, ["site", "ua"], "left_semi")


def _beginning(pattern: Column) -> Column:
    """What every path that a pattern matches begins with."""
    return F.regexp_replace(F.regexp_replace(pattern, r"(?s)\*.*\z", ""), r"\$\z", "")


def robots_verdict(urls: DataFrame, groups: DataFrame, rules: DataFrame, user_agent: str = "*") -> DataFrame:
    """``urls(site, url, ...)`` with ``allowed``.

    The longest pattern that matches path and query decides, Allow before Disallow of one length; no
    match or no group allows. The rules of a site travel as one array, so a URL costs one join row.

    Of a site with more than TRIED_RULES rules only those without a literal beginning do. The others
    are keyed by it: each path looks up its own beginnings, of the lengths that its site's rules
    have, and a pattern is tried only on paths that begin as it does.
    """
    request = U.request_path(F.col("url"))
    value = (F.col("len") * 2 + F.col("allow").cast("int")).alias("value")
    mine = _chosen(groups, rules, user_agent).select("site", value, "regex", _beginning(F.col("pattern")).alias("key"), F.col("pattern").rlike(r"\*|\$\z").alias("wild"))
    many = mine.groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") > TRIED_RULES).select("site", F.lit(True).alias("many"))
    mine = mine.join(many, "site", "left").withColumn("keyed", F.coalesce(F.col("many") & (F.length("key") > 1), F.lit(False))).drop("many")
    mine = Scratch(urls.sparkSession, "robots").write(mine)
    tried = mine.groupBy("site").agg(
        F.collect_list(F.when(~F.col("keyed"), F.struct("value", "regex"))).alias("__rules"), F.array_sort(F.collect_set(F.when(F.col("keyed"), F.length("key")))).alias("__lengths")
    )
    held = small(tried, size="aggregate(__rules, 0L, (n, r) -> n + 32 + octet_length(r.regex)) + 4 * size(__lengths)")
    best = F.array_max(F.transform(F.filter("__rules", lambda r: F.regexp_like(F.col("__request"), r["regex"])), lambda r: r["value"]))
    out = urls.withColumn("__request", request).join(held, "site", "left").withColumn("__best", best)
    keyed = mine.where("keyed").groupBy("site", "key").agg(F.collect_list(F.struct("value", "regex", "wild")).alias("ruled"))
    if not mine.where("keyed").isEmpty():
        begins = F.transform(F.filter("__lengths", lambda n: n <= F.length("__request")), lambda n: F.substring(F.col("__request"), F.lit(1), n))
        looked = out.where(F.size("__lengths") > 0).select("site", "__request", "__lengths").distinct().select("site", "__request", F.explode(begins).alias("key"))
        met = looked.join(small(keyed, size="64 + aggregate(ruled, 0L, (n, r) -> n + 32 + octet_length(r.regex))"), ["site", "key"])
        hit = F.array_max(F.transform(F.filter("ruled", lambda r: ~r["wild"] | F.regexp_like(F.col("__request"), r["regex"])), lambda r: r["value"]))
        hits = met.select("site", "__request", hit.alias("hit")).where("hit IS NOT NULL").groupBy("site", "__request").agg(F.max("hit").alias("__hit"))
        out = out.join(hits, ["site", "__request"], "left").withColumn("__best", F.greatest("__best", "__hit"))
    return out.select(*[F.col(c) for c in urls.columns], F.coalesce(F.col("__best") % 2 == 1, F.lit(True)).alias("allowed"))


def robots_conflicts(pages: DataFrame, groups: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page issues (site, url, severity, code, message) and blocked counts (site, blocked).

    Pages listed in a sitemap but disallowed for ``*``. A site without groups has no rules, hence no
    conflicts.
    """
    blocked = robots_verdict(pages.select("site", "url"), groups, rules).where("NOT allowed")
    issues = blocked.select(
        "site", "url", F.lit("warning").alias("severity"), F.lit("ROBOTS_DISALLOWED_IN_SITEMAP").alias("code"), F.lit("URL is listed in the sitemap but blocked by robots.txt.").alias("message")
    )
    return issues, blocked.groupBy("site").agg(F.count("*").alias("blocked"))
