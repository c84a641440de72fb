"""A crawl of stored pages: which of a corpus' pages an audit reaches from its start, and why it stops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import site_key
from ..operators import crawl
from ..sources.html import parse_pages
from ..storage import save
from . import site_files


@dataclass
class StoredCrawl:
    """The corpus' rows that were reached, with their depth; skipped URLs (site, url, reason); and the stop reason."""

    corpus: DataFrame
    skipped: DataFrame
    stop_reason: str

    def skip_counts(self) -> dict[str, int]:
        """By reason: a handful of rows."""
        return {r["reason"]: r["n"] for r in self.skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}


def crawl_corpus(corpus: DataFrame, start_url: str, max_pages: int = crawl.MAX_PAGES, max_depth: int = crawl.MAX_DEPTH, robots_files: DataFrame | None = None) -> StoredCrawl:
    """``corpus`` as for ``audit``; depth is computed anew.  Pages without HTML lead nowhere; a redirect's target counts as
    seen.  The start page being disallowed ends the crawl at once."""
    spark = corpus.sparkSession
    start = spark.createDataFrame([(start_url,)], "url string").select(site_key(F.col("url")).alias("site"), "url")
    readable = corpus.where((F.coalesce("error", F.lit("")) == "") & crawl.is_html(F.col("status"), F.col("content_type")) & F.col("html").isNotNull())
    pages = save(parse_pages(readable.select(F.col("url").alias("requested"), F.col("final_url").alias("page_url"), "html"), ["requested"], url="page_url", fields=("links", "images")))
    links = save(crawl.followed_links(pages.select("site", F.col("requested").alias("url"), "links", "images")))
    moved = corpus.where("redirects > 0 and final_url is not null").select("url", "final_url")
    shut = None
    if robots_files is not None:
        every = links.select(F.col("target").alias("url")).union(start.select("url")).distinct()
        shut = save(site_files.disallowed_urls(every, save(site_files.read_robots(robots_files))).select(site_key(F.col("url")).alias("site"), "url"))
        if shut.where(F.col("url") == start_url).limit(1).count():
            skipped = start.withColumn("reason", F.lit("robots-disallowed"))
            return StoredCrawl(corpus.where("false").drop("depth").withColumn("depth", F.lit(0)), skipped, "start-disallowed")
    reached, skipped = crawl.crawl(start, links, max_pages, max_depth, disallowed=shut, redirects=moved)
    reason = crawl.stop_reasons(reached, skipped).first()
    found = corpus.drop("depth").join(reached.select(F.col("url").alias("reached"), "depth"), F.col("url") == F.col("reached")).drop("reached")
    return StoredCrawl(found, skipped, reason["stop_reason"] if reason else "completed")
