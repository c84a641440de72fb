"""A crawl over the network, stored for an audit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normal_url, site_key
from ..operators import crawl, sitemaps
from ..sources.fetch import Limits, fetch_urls
from ..sources.html import parse_pages
from ..sources.sitemap import parse_sitemap_files
from ..storage import save
from . import site_files


@dataclass
class LiveCrawl:
    """What ``audit`` takes, and why the crawl stopped."""

    corpus: DataFrame
    robots_files: DataFrame
    sitemap_files: DataFrame
    skipped: DataFrame
    stop_reason: str


def _get(urls: DataFrame, limits: Limits) -> DataFrame:
    return save(fetch_urls(urls.select("url", crawl.request_method(F.col("url")).alias("method")), limits))


def fetch_sitemaps(seeds: DataFrame, limits: Limits, max_files: int = sitemaps.MAX_FILES, max_depth: int = sitemaps.MAX_DEPTH) -> DataFrame:
    """(url, status, error, body) of the sitemaps reached from ``seeds`` (url), at most ``max_files``."""
    level, found = save(seeds.select("url").distinct().orderBy("url").limit(max_files)), []
    for depth in range(max_depth + 1):
        files = save(fetch_urls(level.withColumn("method", F.lit("GET")), limits).select("url", "status", "error", "body"))
        found.append(files)
        seen = reduce(DataFrame.union, [f.select("url") for f in found])
        room = max_files - seen.count()
        if depth == max_depth or room <= 0:
            break
        index = parse_sitemap_files(files.where("error = '' and status between 200 and 299").select("url", "body"), ["url"]).where("kind = 'sitemapindex'")
        level = save(index.select(F.explode("entries.loc").alias("loc")).select(normal_url(F.col("loc")).alias("url")).where("url <> ''").distinct().join(seen, "url", "left_anti").orderBy("url").limit(room))
        if not level.limit(1).count():
            break
    return reduce(DataFrame.union, found)


def live_crawl(spark: SparkSession, start_url: str, max_pages: int = crawl.MAX_PAGES, max_depth: int = crawl.MAX_DEPTH, limits: Limits | None = None) -> LiveCrawl:
    """Breadth first from ``start_url`` (in normal form): a level is fetched by a task for each host, its pages are parsed,
    and what they link to inside the site, seen for the first time and allowed by robots.txt, is the next level."""
    limits = limits or Limits()
    start = spark.createDataFrame([(start_url,)], "url string").select(site_key(F.col("url")).alias("site"), "url")
    robots_files = save(fetch_urls(start.select(site_files.robots_address(F.col("url")).alias("url"), F.lit("GET").alias("method")), limits)).select("url", "final_url", "status", "error", F.decode("body", "UTF-8").alias("body"))
    parsed = save(site_files.read_robots(robots_files))
    seeds = site_files.declared_seeds(parsed).union(site_files.default_seed(start_url, spark))
    maps = save(fetch_sitemaps(seeds, limits))
    fetched: list[DataFrame] = []

    def shut(urls: DataFrame) -> DataFrame:
        return site_files.disallowed_urls(urls, parsed).select(site_key(F.col("url")).alias("site"), "url")

    def expand(level: DataFrame) -> tuple[DataFrame, DataFrame]:
        answers = save(_get(level, limits).join(level.select(F.col("url").alias("u"), "depth"), F.col("url") == F.col("u")).drop("u"))
        fetched.append(answers)
        readable = answers.where((F.col("error") == "") & crawl.is_html(F.col("status"), F.col("content_type")) & F.col("body").isNotNull())
        pages = save(parse_pages(readable.select(F.col("url").alias("requested"), F.col("final_url").alias("page_url"), F.col("body").alias("html"), "headers"), ["requested"], url="page_url", headers="headers", fields=("links", "images")))
        moved = answers.where("redirects > 0").select("url", "final_url")
        return crawl.followed_links(pages.select("site", F.col("requested").alias("url"), "links", "images")), moved

    if shut(start.select("url")).limit(1).count():
        skipped, reason, corpus = start.withColumn("reason", F.lit("robots-disallowed")), "start-disallowed", _get(start.limit(0), limits).withColumn("depth", F.lit(0))
    else:
        listed = sitemaps.listed_urls(parse_sitemap_files(maps.select("url", "body"), ["url"]).withColumn("site", site_key(F.lit(start_url))))
        reached, skipped = crawl.crawl(start, expand, max_pages, max_depth, seeds=listed.where("state = 'ok'").select("site", "url"), disallowed=shut)
        corpus, reason = reduce(DataFrame.unionByName, fetched), crawl.stop_reasons(reached, skipped).first()["stop_reason"]
    out = corpus.select("url", "depth", "status", "error", "redirects", "final_url", "content_type", "headers", F.col("body").alias("html"))
    return LiveCrawl(out, robots_files, maps, skipped, reason)
