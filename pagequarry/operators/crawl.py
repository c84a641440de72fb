"""A level-by-level crawl of stored pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import is_resource_url
from ..storage import save
from .traps import admitted

MAX_PAGES, MAX_DEPTH = 500, 10
Expand = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
Judge = Callable[[DataFrame], DataFrame]


def queue_limit(max_pages: int) -> int:
    return min(max(10 * max_pages, 1000), 100_000)


def crawl(starts: DataFrame, links: DataFrame | Expand, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH, seeds: DataFrame | None = None, disallowed: DataFrame | Judge | None = None, redirects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages (site, url, depth) in the order of a breadth-first crawl, and skipped URLs (site, url, reason).

    ``starts``, ``seeds``, ``disallowed``: site, url; ``links``: site, source, target; ``redirects``: url, final_url.
    Instead of tables of all links and refusals, ``links`` may be a function from a level (site, url, depth) to its links
    and redirects, and ``disallowed`` one from URLs to those that are refused.
    All sites go forward a level at a time; a level is joined with the links, cleared of URLs seen, and filtered by
    depth, robots, traps, queue and page limit, each site for itself.  Levels are at most max_depth + 1."""
    level = save(starts.select("site", "url").distinct().withColumn("depth", F.lit(0)))
    pages, skipped, seen, passed = level, None, level.select("site", "url"), None
    for depth in range(1, max_depth + 2):
        if callable(links):
            known, redirects = links(level)
        else:
            known = links
        reached = level.join(known.withColumnRenamed("site", "site_"), (F.col("url") == F.col("source")) & (F.col("site") == F.col("site_"))).select("site", F.col("target").alias("url"))
        if depth == 1 and seeds is not None:
            reached = reached.union(seeds.select("site", "url"))
        if redirects is not None:
            seen = save(seen.union(level.join(redirects, "url").select("site", F.col("final_url").alias("url"))).distinct())
        new = save(reached.distinct().join(seen, ["site", "url"], "left_anti"))
        if not new.limit(1).count():
            break
        seen = save(seen.union(new.select("site", "url")))
        if depth > max_depth:
            refused = new.withColumn("reason", F.lit("max-depth"))
            skipped = refused if skipped is None else skipped.unionByName(refused)
            break
        judged = new
        if disallowed is not None:
            refused = disallowed(judged.select("url")) if callable(disallowed) else disallowed
            shut = refused.select("site", "url").distinct().withColumn("shut", F.lit(True))
            judged = judged.join(shut, ["site", "url"], "left")
        else:
            judged = judged.withColumn("shut", F.lit(None).cast("boolean"))
        judged = save(judged)
        # The trap limits hold for the whole crawl: what earlier levels let through counts first.
        fresh = judged.where("shut is null").select("site", "url", F.lit(depth).alias("depth"))
        guarded = fresh if passed is None else passed.unionByName(fresh)
        allowed = save(admitted(guarded, "url", ["depth", "url"]).where(F.col("depth") == depth).withColumnRenamed("trap", "reason"))
        through = allowed.where("reason is null").select("site", "url", "depth")
        passed = through if passed is None else save(passed.unionByName(through))
        shut = judged.where("shut").withColumn("reason", F.lit("robots-disallowed"))
        ranked = allowed.where("reason is null").withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("url")))
        room = pages.groupBy("site").agg((F.lit(max_pages) - F.count(F.lit(1))).alias("room"))
        ranked = ranked.join(room, "site")
        reason = F.when(F.col("k") > queue_limit(max_pages), "queue-full").when(F.col("k") > F.col("room"), "max-pages")
        ranked = save(ranked.withColumn("reason", reason))
        refused = allowed.where("reason is not null").select("site", "url", "reason").union(shut.select("site", "url", "reason")).union(ranked.where("reason is not null").select("site", "url", "reason"))
        skipped = refused if skipped is None else skipped.unionByName(refused)
        level = save(ranked.where("reason is null").select("site", "url", F.lit(depth).alias("depth")))
        pages = save(pages.union(level))
        if not level.limit(1).count():
            break
    if skipped is None:
        skipped = starts.select("site", "url", F.lit("").alias("reason")).limit(0)
    return pages, save(skipped)


def followed_links(pages: DataFrame) -> DataFrame:
    """(site, source, target): what a crawl of ``pages`` (site, url, links, images) follows: links inside the site and its
    own images, each target once."""
    own = lambda field, place: F.transform(F.filter(field, lambda x: ~x["external"] & (x[place] != "")), lambda x: x[place])
    targets = F.array_distinct(F.concat(own("links", "url"), own("images", "src")))
    return pages.select("site", F.col("url").alias("source"), F.explode(targets).alias("target"))


def request_method(url: Column) -> Column:
    """Files other than pages are only asked for their head."""
    return F.when(is_resource_url(url), "HEAD").otherwise("GET")


def stop_reasons(pages: DataFrame, skipped: DataFrame) -> DataFrame:
    """(site, pages, stop_reason): why a site's crawl ended: its page limit, its depth limit, or nothing left to follow."""
    counts = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    hit = skipped.groupBy("site").agg(F.max((F.col("reason") == "max-pages").cast("int")).alias("full"), F.max((F.col("reason") == "max-depth").cast("int")).alias("deep"))
    reason = F.when(F.col("full") == 1, "max-pages").when(F.col("deep") == 1, "max-depth").otherwise("completed")
    return counts.join(hit, "site", "left").select("site", "pages", reason.alias("stop_reason"))


def skip_counts(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("site", "reason").agg(F.count(F.lit(1)).alias("n"))


def is_html(status, content_type):
    """A successful response of an HTML type, or of none."""
    kind = F.lower(F.btrim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return status.between(200, 299) & kind.isin("", "text/html", "application/xhtml+xml")
