"""Sitemap discovery, expansion and entries."""

from __future__ import annotations

import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions import urls as U
from ..scratch import Scratch

LOC = r"(?i)<loc[^>]*>\s*([^<\s]+)\s*</loc>"
LASTMOD = r"(?i)<lastmod[^>]*>\s*([^<\s]+)\s*</lastmod>"
#: Characters before and after a recovered loc among which its lastmod is looked for.
NEAR = (600, 1200)
#: What a page of bot protection says near its beginning.
BLOCKED = r"(?i)cloudflare|access denied|captcha|bot detection|verify you are human|akamai|perimeterx|blocked|forbidden"
#: Markup that ends; the parser gives up only at markup that doesn't, not at elements left open.
MARKUP = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?!!--|!\[CDATA\[|\?)[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
INDEX_SCHEMA = "sitemap array<struct<loc:string>>"
URLSET_SCHEMA = "url array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>"


def seed_sitemaps(sites: DataFrame, directives: DataFrame, profile: str = "full") -> DataFrame:
    """(site, cand_pos, base, pos, sitemap_url, from_robots) to start from.

    Full: the usable directives of ``sites(site)``, else ``/sitemap.xml`` of its origin. Preview: a
    candidate per host variant, in order, with its usable same-host directives or else the common
    paths; an input that is itself a sitemap is the only seed. ``directives(site, pos, sitemap_url,
    usable)`` has the site's robots in the full profile, and in the preview those of each variant's
    origin under ``site``.
    """
    usable = directives.where("usable").select(F.col("site").alias("base"), F.col("pos").alias("rpos"), F.col("sitemap_url").alias("stated"))
    if profile == "preview":
        mode = U.input_mode(F.col("site"))
        direct = sites.where(mode == "sitemap").select(
            "site", F.lit(0).alias("cand_pos"), U.origin(F.col("site")).alias("base"), F.lit(0).alias("pos"), U.norm_url(F.col("site")).alias("sitemap_url"), F.lit(False).alias("from_robots")
        )
        bases = sites.where(mode == "site").select("site", F.posexplode(U.host_variants(U.norm_site(F.col("site")))).alias("cand_pos", "base"))
        usable = usable.where(U.same_host(F.col("stated"), F.col("base")))
        fallback = F.array(*[F.concat("base", F.lit(p)) for p in U.COMMON_SITEMAPS])
    else:
        direct = None
        bases = sites.select("site", F.lit(0).alias("cand_pos"), F.col("site").alias("base"))
        fallback = F.array(F.concat(U.origin(U.norm_site(F.col("base"))), F.lit("/sitemap.xml")))
    listed = usable.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("rpos", "stated"))).alias("stated"))
    seeds = (
        bases.join(listed, "base", "left")
        .withColumn("from_robots", F.col("stated").isNotNull())
        .select(
            "site", "cand_pos", "base", F.posexplode(F.when(F.col("from_robots"), F.col("stated")["stated"]).otherwise(fallback)).alias("pos", "sitemap_url"), "from_robots"
        )
    )
    return seeds if direct is None else seeds.unionByName(direct)


def discovery_notes(directives: DataFrame, limit: int = 10) -> DataFrame:
    """(site, n, message) of the first ``limit`` ignored directives of each site, numbered in order."""
    first = Window.partitionBy("site").orderBy("pos")
    return (
        directives.where("NOT usable")
        .withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= limit)
        .select("site", "n", F.concat(F.lit("Ignored non-XML Sitemap directive: "), "sitemap_url").alias("message"))
    )


def sitemap_notes(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(site, depth, bfs_pos, kind, message): what went wrong with the preview's ``files``, in order.

    Kinds: 0 looks blocked, 1 the parser gave up, 2 nothing of the host that is new was found, 3 not
    fetched. A child is new if no file visited up to then is that child.
    """
    met = files.join(docs.select(F.col("url").alias("sitemap_url"), "status", "body", "error").hint("merge"), "sitemap_url", "left")
    body = F.col("body")
    blocked = F.col("status").isin(403, 429) | F.substring(body, 1, 1200).rlike(BLOCKED)
    left = F.regexp_extract(F.regexp_replace(body, MARKUP, ""), r"(?s)<.{0,3}", 0)
    told = F.array_compact(
        F.array(
            F.when(F.col("loaded") & blocked, F.struct(F.lit(0).alias("kind"), F.lit(" looks blocked or challenged by bot protection.").alias("text"))),
            F.when(F.col("loaded") & (left != ""), F.struct(F.lit(1).alias("kind"), F.concat(F.lit(" XML parser fallback used: "), _unclosed(left)).alias("text"))),
            F.when(~F.col("loaded"), F.struct(F.lit(3).alias("kind"), F.concat(F.lit(" failed: "), _reason()).alias("text"))),
        )
    )
    place = ["site", "depth", "bfs_pos", "sitemap_url"]
    stated = met.select(*place, F.inline(told))
    ours = lambda u: F.coalesce(U.same_host(u, _site_url()), F.lit(False))
    none = F.array().cast("array<string>")
    parsed = structured(met.where("loaded"))
    items, children = F.coalesce(F.col("items.loc"), none), F.coalesce("children", none)
    bare = (
        parsed.select(*place, items.alias("items"), children.alias("children"), recovered_locs(body).alias("locs"))
        .where(~F.exists("items", ours) & ~F.exists("locs", lambda u: ours(u) & U.is_page_url(u)))
        .select(*place, F.transform(F.filter(F.concat("children", "locs"), lambda u: ours(u) & U.is_sitemap_url(u)), U.norm_url).alias("below"))
    )
    seen = files.select("site", F.col("sitemap_url").alias("child"), F.struct("depth", "bfs_pos").alias("at"))
    new = (
        bare.select("site", "sitemap_url", F.struct("depth", "bfs_pos").alias("here"), F.explode("below").alias("child"))
        .join(seen, ["site", "child"], "left")
        .where(F.col("at").isNull() | (F.col("at") > F.col("here")))
        .select("site", "sitemap_url")
    )
    empty = bare.join(new, ["site", "sitemap_url"], "left_anti").select(*place, F.lit(2).alias("kind"), F.lit(" loaded but produced 0 same-host sitemap children or URL entries.").alias("text"))
    return stated.unionByName(empty).select("site", "depth", "bfs_pos", "kind", F.concat("sitemap_url", "text").alias("message"))


def source_diagnostics(sources: DataFrame, docs: DataFrame, directives: DataFrame, files: DataFrame, notes: DataFrame) -> DataFrame:
    """(site, tested_urls, failures): what the preview tried for each of its sources, and what went wrong.

    ``sources(site, input_mode, from_robots)`` are the chosen candidates. Tested are the robots file,
    then the loaded files and then the failed ones, in visiting order. Failures begin with the robots
    file's (ignored directives, none usable, not fetched; none of a sitemap given directly, which is
    stated instead) and end with the ``notes`` of :func:`sitemap_notes`, in order. Both lists are
    bounded by the profile's bound on files.
    """
    robots_url = F.concat(U.origin(F.col("site")), F.lit("/robots.txt"))
    direct = F.col("input_mode") == "sitemap"
    at = lambda step, depth, pos, kind, text: F.struct(
        F.lit(step).alias("step"), depth.cast("int").alias("depth"), pos.cast("array<int>").alias("pos"), kind.cast("int").alias("kind"), text.alias("text")
    )
    zero, none = F.lit(0), F.array()
    met = docs.select(F.col("url").alias("robots_url"), "error", F.lit(True).alias("met"))
    asked = sources.withColumn("robots_url", robots_url)
    answered = F.coalesce("met", F.lit(False)) & F.col("error").isNull()
    of_robots = F.when(answered, F.lit(" loaded but did not expose usable same-host XML Sitemap directives.")).otherwise(F.concat(F.lit(" failed: "), _reason()))
    stated = asked.join(met, "robots_url", "left").where(direct | ~F.col("from_robots")).select(
        "site", at(1, zero, none, zero, F.when(direct, F.lit("Direct sitemap input.")).otherwise(F.concat("robots_url", of_robots))).alias("f")
    )
    ignored = discovery_notes(directives).join(sources.where(~direct).select("site"), "site", "left_semi").select("site", at(0, F.col("n"), none, zero, F.col("message")).alias("f"))
    later = notes.join(sources.select("site"), "site", "left_semi").select("site", at(2, F.col("depth"), F.col("bfs_pos"), F.col("kind"), F.col("message")).alias("f"))
    failures = stated.unionByName(ignored).unionByName(later).groupBy("site").agg(F.array_sort(F.collect_list("f")).alias("f"))
    tested = files.groupBy("site").agg(F.array_sort(F.collect_list(F.struct((~F.col("loaded")).alias("failed"), "depth", "bfs_pos", "sitemap_url"))).alias("t"))
    texts = F.array().cast("array<string>")
    return asked.join(tested, "site", "left").join(failures, "site", "left").select(
        "site", F.concat(F.array("robots_url"), F.coalesce(F.col("t.sitemap_url"), texts)).alias("tested_urls"), F.coalesce(F.col("f.text"), texts).alias("failures")
    )


def _reason() -> Column:
    return F.coalesce("error", F.lit("fetch failed"))


def _unclosed(left: Column) -> Column:
    """What the reference's parser says of markup that begins so and never ends."""
    return (
        F.when(left.startswith("<!--"), "Comment is not closed.")
        .when(left.startswith("<!["), "CDATA is not closed.")
        .when(left.startswith("<!D"), "Unclosed DOCTYPE")
        .when(left.startswith("<?"), "Pi Tag is not closed.")
        .when(left.startswith("</"), "Closing Tag is not closed.")
        .otherwise("Tag is not closed.")
    )


def recovered_locs(body: Column) -> Column:
    """Distinct normal forms of every ``<loc>`` of a body, in order of their first place."""
    found = F.regexp_extract_all(body, F.lit(LOC), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: U.norm_url(T.decode_entities(x))), lambda x: x.isNotNull()))


#: A URL in a text, wherever it begins, within another one too; and a lastmod element likewise.
_LASTMOD = re.compile(LASTMOD[4:], re.A | re.I)
#: So many locs of a file are looked up without a list of its URLs.
FEW = 8
_URLS, _LASTMODS = re.compile(r'(?=(https?://[^\s<>"]*))', re.A), re.compile(f"(?=({LASTMOD[4:]}))", re.A | re.I)


def lastmods_near(body: str, locs: list[str]) -> list[str | None]:
    """For each of ``locs`` the first ``<lastmod>`` around its first place in ``body``; None if it stands nowhere.

    One pass lists the URLs with their places, another the lastmods. A loc stands first where the
    first URL stands that begins with it, and those are neighbours in alphabetical order. A few locs
    are looked up one by one instead.
    """
    if len(locs) <= FEW:
        out = []
        for loc in locs:
            at = body.find(loc)
            near = _LASTMOD.search(body, max(at - NEAR[0], 0), at + NEAR[1]) if at >= 0 else None
            out.append(near and near[1])
        return out
    urls = sorted((m[1], m.start()) for m in _URLS.finditer(body))
    places = np.array([at for _, at in urls], dtype=np.int64)
    marks = [(m.start(), m.end(1), m[2]) for m in _LASTMODS.finditer(body)]
    starts, out = [m[0] for m in marks], []
    for loc in locs:
        lo, hi = bisect_left(urls, (loc,)), bisect_left(urls, (f"{loc}\U0010ffff",))
        at = int(places[lo:hi].min()) if hi > lo else body.find(loc) if re.search(r'[\s<>"]', loc) else -1
        found = None
        if at >= 0:
            i = bisect_left(starts, at - NEAR[0])
            while found is None and i < len(marks) and marks[i][0] < at + NEAR[1]:
                found = marks[i][2] if marks[i][1] <= at + NEAR[1] else None
                i += 1
        out.append(found)
    return out


def with_lastmods(df: DataFrame) -> DataFrame:
    """``df(body, locs, ...)`` with ``lastmods``, one for each of ``locs``, in place of the body.

    A file is read once, whatever its number of URLs, and no row carries it any further.
    """
    kept = [c for c in df.columns if c != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, locs = (batch.column(batch.schema.get_field_index(c)) for c in ("body", "locs"))
            near = [None if not (b.is_valid and u.is_valid) else lastmods_near(b.as_py(), u.as_py()) for b, u in zip(body, locs, strict=True)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(near, pa.list_(pa.string()))], names=[*kept, "lastmods"])

    return df.mapInArrow(run, df.select(kept).schema.add("lastmods", ArrayType(StringType())))


def structured(docs: DataFrame) -> DataFrame:
    """``docs(body, ...)`` with ``children`` and ``items``: what parses of an index and of a urlset.

    A body that doesn't parse gives nulls, and recovery finds its URLs.
    """
    index = F.from_xml("body", INDEX_SCHEMA)
    urlset = F.from_xml("body", URLSET_SCHEMA)
    return docs.withColumn("children", F.when(F.contains("body", F.lit("<sitemapindex")), index["sitemap"]["loc"])).withColumn(
        "items", F.when(F.contains("body", F.lit("<urlset")), urlset["url"])
    )


def expand_sitemaps(seeds: DataFrame, docs: DataFrame, profile: str = "full", max_depth: int = 50, max_files: int | None = None, max_urls: int | None = None) -> DataFrame:
    """Breadth-first expansion of ``seeds(site, sitemap_url, pos)``: (site, sitemap_url, depth, bfs_pos, loaded, room).

    ``docs(url, ok, error, body)`` are followed documents. Each file is visited once per site, at its
    first place in breadth-first order; ``bfs_pos`` compares as that order does within a depth.
    Children are those of a parsed index (of any host in the full profile), then recovered same-host
    locs that look like sitemaps. A file is loaded if it was fetched, in the full profile with 2xx.
    Each level is written, without bodies, which cuts the lineage; ``max_depth`` guards against
    endless generated trees, and a warning says how many deeper files were left.

    ``max_files`` files of a site are visited at most, in order. With ``max_urls`` a site ends with
    the file that brings it to that many different page URLs: new URLs are counted per file, their
    running total per site tells the ``room`` left when a file is begun (null without the bound), and
    a file without room isn't visited, nor is any later level of its site.
    """
    scratch = Scratch(seeds.sparkSession, "sitemaps")
    fetched = F.col("error").isNull() & F.col("body").isNotNull()
    good = fetched if profile == "preview" else fetched & F.coalesce("ok", F.lit(False))
    front = seeds.where(U.is_sitemap_url(F.col("sitemap_url"))).select("site", U.norm_url(F.col("sitemap_url")).alias("sitemap_url"), F.array(F.col("pos").cast("int")).alias("bfs_pos"))
    seen, levels, known, spent = None, [], None, None
    once = Window.partitionBy("site", "sitemap_url").orderBy("bfs_pos")
    in_order = Window.partitionBy("site").orderBy("bfs_pos")
    for depth in range(max_depth):
        front = front.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
        if seen is not None:
            front = front.join(seen, ["site", "sitemap_url"], "left_anti")
        if spent is not None:
            front = front.join(spent, "site", "left").na.fill(0, ["files", "urls"])
            if max_urls is not None:
                front = front.where(F.col("urls") < max_urls)
        else:
            front = front.withColumns({"files": F.lit(0).cast("long"), "urls": F.lit(0).cast("long")})
        if max_files is not None:
            # The bare rank first: Spark limits it before the shuffle.
            front = front.withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= max_files).where(F.col("n") + F.col("files") <= max_files).drop("n")
        met = front.join(docs.select(F.col("url").alias("sitemap_url"), "ok", "error", "body").hint("merge"), "sitemap_url", "left")
        level = scratch.write(
            structured(met.withColumn("locs", recovered_locs(F.col("body")))).select(
                "site",
                "sitemap_url",
                F.lit(depth).alias("depth"),
                "bfs_pos",
                good.alias("loaded"),
                "files",
                "urls",
                F.when(
                    good,
                    F.concat(
                        F.transform(F.coalesce("children", F.array().cast("array<string>")), lambda x: F.struct(x.alias("u"), F.lit(profile == "preview").alias("own"))),
                        F.transform("locs", lambda x: F.struct(x.alias("u"), F.lit(True).alias("own"))),
                    ),
                ).alias("found"),
                *([] if max_urls is None else ["items", "locs"]),
            )
        )
        if level.isEmpty():
            break
        if max_urls is None:
            level = level.withColumn("room", F.lit(None).cast("long"))
        else:
            firsts = _candidates(level.where("loaded"), profile).groupBy("site", "url").agg(F.min("bfs_pos").alias("bfs_pos"))
            if known is not None:
                firsts = firsts.join(known, ["site", "url"], "left_anti")
            firsts = scratch.write(firsts)
            fresh = firsts.groupBy("site", "bfs_pos").agg(F.count("*").alias("fresh"))
            level = level.join(fresh, ["site", "bfs_pos"], "left").na.fill(0, ["fresh"])
            before = F.col("urls") + F.coalesce(F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            level = scratch.write(level.drop("items", "locs").withColumn("room", max_urls - before).where("room > 0"))
            urls = firsts.select("site", "url")
            known = urls if known is None else known.unionByName(urls)
        levels.append(level)
        ids = level.select("site", "sitemap_url")
        seen = ids if seen is None else seen.union(ids)
        if max_files is not None or max_urls is not None:
            total = F.max("urls") + (F.sum("fresh") if max_urls is not None else F.lit(0))
            now = level.groupBy("site").agg((F.max("files") + F.count("*")).alias("files"), total.alias("urls"))
            # A site without a file on this level has none on the next one.
            spent = scratch.write(now)
        front = (
            level.select("site", "bfs_pos", F.posexplode("found").alias("i", "f"))
            .where(U.is_sitemap_url(F.col("f.u")) & (~F.col("f.own") | U.same_host(F.col("f.u"), _site_url())))
            .select("site", U.norm_url(F.col("f.u")).alias("sitemap_url"), F.concat("bfs_pos", F.array("i")).alias("bfs_pos"))
        )
    else:
        left = front.select("site", "sitemap_url").distinct()
        deeper = (left if seen is None else left.join(seen, ["site", "sitemap_url"], "left_anti")).count()
        if deeper:
            warnings.warn(f"{deeper} sitemap files lie deeper than {max_depth} levels and were not visited", stacklevel=2)
    cols = ["site", "sitemap_url", "depth", "bfs_pos", "loaded", "room"]
    if not levels:
        return seeds.sparkSession.createDataFrame([], "site string, sitemap_url string, depth int, bfs_pos array<int>, loaded boolean, room long")
    return reduce(DataFrame.unionByName, [x.select(cols) for x in levels])


def _site_url() -> Column:
    return F.when(U.is_url(F.col("site")), F.col("site")).otherwise(F.concat(F.lit("https://"), "site"))


def _read(files: DataFrame, docs: DataFrame) -> DataFrame:
    """``files(sitemap_url, ...)`` with the body, children, items and recovered locs of their documents.

    Bodies pack well, so a small table of them may be large in memory: it isn't to be broadcast.
    """
    met = files.join(docs.select(F.col("url").alias("sitemap_url"), "body").hint("merge"), "sitemap_url")
    return structured(met).withColumn("locs", recovered_locs(F.col("body")))


def _candidates(read: DataFrame, profile: str, lastmods: bool = False) -> DataFrame:
    """Listings of pages by loaded files, in the order of ``depth``, ``bfs_pos``, ``recovered`` and ``i``.

    (site, url, depth, bfs_pos, recovered, i, lead, lastmod, changefreq, priority) of files that are
    ``read``: a URL is normalised, of the site's host, and no sitemap. ``lead`` marks a file's first
    recovered loc of the host. Other recovered locs that are items of their file too are left out, for
    the item comes first. The lastmods of recovered locs are looked for only if asked.
    """
    none = F.lit(None).cast("string")
    place = ["site", "depth", "bfs_pos"]
    # Of a URL in normal form the host is what stands behind scheme and login.
    host = lambda u: F.regexp_extract(u, r"\A\w+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    held = read.withColumns(
        {
            "own_host": U.url_host(_site_url()),
            "items": F.coalesce("items", F.array().cast("array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>")),
            "named": F.transform(F.coalesce("items.loc", F.array().cast("array<string>")), U.norm_url),
        }
    )
    # Bound by let, for the optimizer may put an expression where its column stands within a lambda, and then each element costs it.
    held = held.withColumn("first", U.let(F.col("own_host"), lambda own: F.get(F.filter("locs", lambda u: host(u) == own), F.lit(0))))
    # The first of the host stays in front; what stands before it is of other hosts.
    rest = F.array_compact(F.array_union(F.array("first"), F.array_except("locs", "named")))
    held = held.select(*place, "items", "named", "first", *(["body"] if lastmods else []), rest.alias("locs"))
    held = with_lastmods(held) if lastmods else held.withColumn("lastmods", F.array().cast("array<string>"))

    def row(recovered: int, i: Column, url: Column, lead: Column, *told: Column) -> Column:
        names = ("lastmod", "changefreq", "priority")
        return F.struct(F.lit(recovered).alias("recovered"), i.alias("i"), url.alias("url"), lead.alias("lead"), *[t.alias(n) for t, n in zip(told, names, strict=True)])

    items = U.let(F.col("named"), lambda n: F.transform("items", lambda x, i: row(0, i, F.get(n, i), F.lit(False), T.empty_to_null(x["lastmod"]), x["changefreq"], x["priority"])))
    found = U.let(F.col("first"), lambda f: F.transform("locs", lambda u, i: row(1, i, u, u == f, F.get("lastmods", i), none, none)))
    # The outer form gets no filter on its input's size, which would make all rows a second time; its null rows go below.
    listed = held.select(*place, F.concat(items, found).alias("rows")).select(*place, F.inline_outer("rows"))
    if profile == "preview":
        listed = listed.where((F.col("recovered") == 0) | U.is_page_url(F.col("url")))
    return listed.where(F.col("url").isNotNull() & U.same_host(F.col("url"), _site_url()) & ~U.is_sitemap_url(F.col("url")))


def sitemap_entries(files: DataFrame, docs: DataFrame, profile: str = "full") -> DataFrame:
    """Entries (site, url, lastmod, changefreq, priority) of the loaded ``files``.

    URLs are normalised, of the site's host, and not sitemaps. The first of a URL wins: an earlier
    file beats a later one, and within a file a parsed item beats a recovered loc, so that a
    neighbour's lastmod never overwrites an entry that has none. The group's key is (site, url), so
    a huge site spreads over all tasks; hosts are filtered before it.

    Of a file with ``room`` for so many new URLs the first ones stay, as found. Where the parsed
    items fill it, the file's first recovered loc of the host is still taken, for the bound is looked
    at behind it. Places are counted within a file, whose length the protocol bounds.
    """
    place, listed = F.struct("depth", "bfs_pos", "recovered", "i"), ("lastmod", "changefreq", "priority")
    every = _candidates(_read(files.where("loaded"), docs), profile, lastmods=True).withColumns({"place": place, "entry": F.struct(*listed)})
    won = every.groupBy("site", "url").agg(F.min_by(F.struct("place", "entry"), "place").alias("w"), F.min_by(F.struct("place", "entry"), F.when(F.col("lead"), F.col("place"))).alias("l"))
    won = won.select("site", "url", "w.place.depth", "w.place.bfs_pos", F.col("w.place").alias("place"), F.col("w.entry").alias("entry"), F.col("l").alias("l"))
    bound = files.where("room IS NOT NULL").select("site", "depth", "bfs_pos", "room")
    file = Window.partitionBy("site", "depth", "bfs_pos")
    rank, items = F.row_number().over(file.orderBy("place.recovered", "place.i")), F.count_if(F.col("place.recovered") == 0).over(file)
    same_file = (F.col("l.place.depth") == F.col("depth")) & (F.col("l.place.bfs_pos") == F.col("bfs_pos"))
    if "room" in files.columns and not bound.isEmpty():
        won = won.join(bound, ["site", "depth", "bfs_pos"]).withColumns({"rank": rank, "items": items})
        inside = F.col("rank") <= F.col("room")
        led = F.coalesce(same_file, F.lit(False)) & (F.col("items") >= F.col("room"))
        won = won.where(inside | led).withColumn("entry", F.when(inside, F.col("entry")).otherwise(F.col("l.entry")))
    return won.select("site", "url", "entry.*")


def cap_pages(entries: DataFrame, max_pages: int, collation: str | None = None) -> DataFrame:
    """The first ``max_pages`` entries of each site by URL, in the order of ``collation`` if one is given."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy(*T.collated("url", collation)))
    return entries.withColumn("n", rank).where(F.col("n") <= max_pages).drop("n")


def failed_sitemaps(files: DataFrame) -> DataFrame:
    return files.where("NOT loaded").select("site", "sitemap_url", "depth", "bfs_pos")


def choose_candidate(candidates: DataFrame) -> DataFrame:
    """One of ``candidates(site, cand_pos, n_entries, n_loaded, ...)`` for each site.

    The first that has entries, else the first with a loaded file, else the first.
    """
    best = Window.partitionBy("site").orderBy((F.col("n_entries") > 0).desc(), (F.col("n_loaded") > 0).desc(), "cand_pos")
    return candidates.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def sitemap_tree(files: DataFrame) -> DataFrame:
    """(site, sitemap_url, depth, parent): each file with the file that lists it first."""
    parents = files.select("site", F.col("sitemap_url").alias("parent"), F.col("bfs_pos").alias("up"))
    above = F.when(F.size("bfs_pos") > 1, F.slice("bfs_pos", F.lit(1), F.size("bfs_pos") - 1))
    return files.withColumn("up", above).join(parents, ["site", "up"], "left").select("site", "sitemap_url", "depth", "parent")
