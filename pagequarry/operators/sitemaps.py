"""Sitemap discovery and sitemaps against the crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import in_scope, normal_url
from .findings import finding, lines, spread

MAX_FILES, MAX_URLS, MAX_DEPTH, MAX_LISTED = 50, 50_000, 2, 100


def reached_files(files: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Files reached from ``seeds`` (site, url, source, declared) through indexes, with their place ``k`` in breadth-first
    order of their site.

    ``files``: url and the parsed fields of every stored file.  Adds site, source, depth, declared."""
    level = seeds.select("site", "url", "source", "declared", F.lit(0).alias("depth"), F.lit(0).alias("pos"))
    found = None
    for depth in range(max_depth + 1):
        level = level.withColumn("k", F.row_number().over(Window.partitionBy("site", "url").orderBy("pos", "source"))).where("k = 1").drop("k")
        if found is not None:
            level = level.join(found.select("site", "url"), ["site", "url"], "left_anti")
        here = level.join(files, "url")
        found = here if found is None else found.unionByName(here)
        if depth < max_depth:
            index = here.where("kind = 'sitemapindex'")
            level = index.select("site", F.col("url").alias("source"), F.lit(True).alias("declared"), F.posexplode("entries").alias("pos", "e")).select("site", normal_url(F.col("e.loc")).alias("url"), "source", "declared", F.lit(depth + 1).alias("depth"), "pos")
    rank = F.row_number().over(Window.partitionBy("site").orderBy("depth", "source", "pos", "url"))
    return found.withColumn("k", rank).drop("pos")


def collect_files(files: DataFrame, seeds: DataFrame, max_files: int = MAX_FILES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The first ``max_files`` of each site's ``reached_files``."""
    return reached_files(files, seeds, max_depth).where(F.col("k") <= max_files).drop("k")


def skipped_files(reached: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """(site, left_out): how many of a site's files are beyond ``max_files``."""
    return reached.groupBy("site").agg(F.count_if(F.col("k") > max_files).alias("left_out"))


def listed_urls(files: DataFrame) -> DataFrame:
    """(site, sitemap, loc, url, state) of each entry of a url set; state: ok, out-of-scope or invalid; url is normal."""
    rows = files.where("kind = 'urlset'").select("site", F.col("url").alias("sitemap"), F.explode("entries").alias("e")).select("site", "sitemap", F.col("e.loc").alias("loc"), F.col("e.lastmod").alias("lastmod"))
    rows = rows.withColumn("url", normal_url(F.col("loc")))
    state = F.when(F.col("url") == "", "invalid").when(~in_scope(F.col("url"), F.col("site")), "out-of-scope").otherwise("ok")
    return rows.withColumn("state", state)


def sitemap_urls(listed: DataFrame, most: int = MAX_URLS) -> DataFrame:
    """(site, url, lastmod, sitemap): distinct good URLs of a site in order, ``most`` at most."""
    ok = listed.where("state = 'ok'").groupBy("site", "url").agg(F.min_by(F.struct("lastmod", "sitemap"), "sitemap").alias("f"))
    ranked = ok.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("url"))).where(F.col("k") <= most)
    return ranked.select("site", "url", "f.lastmod", "f.sitemap")


def sitemap_file_findings(files: DataFrame, listed: DataFrame) -> DataFrame:
    """``files``: site, url, status, kind, error, invalid, source, declared, truncated, warnings, entries."""
    own = lambda rule, when, ev: finding("crawlability", rule, F.col("url"), ev, when)
    failed = F.coalesce("error", F.lit("")) != ""
    each = spread(
        files,
        own("SEO-SITEMAP-003", failed & F.col("invalid"), lines(F.col("error"))),
        own("SEO-SITEMAP-002", failed & ~F.col("invalid") & (F.col("declared") | F.col("status").between(200, 299)), lines(F.concat(F.lit("source: "), F.col("source")), F.col("error"))),
        own("SEO-SITEMAP-004", F.col("truncated"), lines(F.concat(F.size("entries").cast("string"), F.lit(" entries")))),
        own("SEO-SITEMAP-005", F.size("warnings") > 0, F.col("warnings")),
    )
    site = files.groupBy("site").agg(F.max((~failed & F.col("kind").isNotNull()) | F.col("declared")).alias("fine"), F.sort_array(F.collect_set(F.concat("url", F.lit(": "), F.coalesce("error", F.lit(""))))).alias("told"))
    none = spread(site, finding("crawlability", "SEO-SITEMAP-001", F.lit(""), F.col("told"), ~F.col("fine")))
    first = F.row_number().over(Window.partitionBy("site", "state").orderBy("url", "loc"))
    few = listed.where("state <> 'ok'").withColumn("k", first).where(F.col("k") <= MAX_LISTED)
    told = F.when(F.col("state") == "invalid", F.concat("sitemap", F.lit(": "), F.col("loc"))).otherwise(F.col("url"))
    bad = few.groupBy("site", "state").agg(F.sort_array(F.collect_list(told)).alias("told"))
    wrong = spread(bad, finding("crawlability", "SEO-SITEMAP-006", F.lit(""), F.col("told"), F.col("state") == "out-of-scope"), finding("crawlability", "SEO-SITEMAP-007", F.lit(""), F.col("told"), F.col("state") == "invalid"))
    return each.union(none).union(wrong)


def sitemap_limits(listed: DataFrame, skipped: DataFrame, most: int = MAX_URLS) -> DataFrame:
    """``skipped`` as of ``skipped_files``."""
    extra = listed.where("state = 'ok'").groupBy("site").agg(F.greatest(F.count_distinct("url") - most, F.lit(0)).alias("over"))
    both = skipped.join(extra, "site", "left").select(F.col("left_out"), F.coalesce("over", F.lit(0)).alias("over"))
    told = lines(F.concat(F.lit("sitemap files not fetched: "), F.col("left_out").cast("string")), F.concat(F.lit("sitemap URLs not recorded: "), F.col("over").cast("string")))
    return spread(both, finding("crawlability", "SEO-SITEMAP-008", F.lit(""), told, (F.col("over") > 0) | (F.col("left_out") > 0)))


def bad_targets(urls: DataFrame, observed: DataFrame, disallowed: DataFrame) -> DataFrame:
    """Listed URLs that failed, redirect, are noindex or name another canonical (``observed``: url, bad), and those that
    robots.txt disallows (``disallowed``: url)."""
    listed = urls.select("url").distinct()
    bad = listed.join(observed.where("bad").select("url").distinct(), "url", "left_semi")
    shut = listed.join(disallowed.select("url").distinct(), "url", "left_semi")
    one = spread(bad, finding("crawlability", "SEO-SITEMAP-010", F.col("url")))
    return one.union(spread(shut, finding("crawlability", "SEO-SITEMAP-010", F.col("url"), lines("disallowed by robots.txt"))))
