"""Findings on a site's robots.txt and sitemaps, and what they say about the crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import path_of, query_of, site_key
from ..operators import robots, sitemaps
from ..sources.robots import PRODUCT, parse_robots_files
from ..sources.sitemap import parse_sitemap_files
from ..storage import save

FILE = ["url", "final_url", "status", "error"]


def robots_address(url):
    """Address of the robots.txt that holds for a URL."""
    return F.concat(F.regexp_extract(url, r"^([a-z]+://[^/]+)", 1), F.lit("/robots.txt"))


def request_path(url):
    return F.concat(path_of(url), F.when(query_of(url) == "", "").otherwise(F.concat(F.lit("?"), query_of(url))))


def read_robots(files: DataFrame) -> DataFrame:
    """``files``: url, final_url, status, error, body.  Adds outcome, size and the parsed fields."""
    told = files.withColumn("outcome", robots.outcome(F.col("status"), F.col("error"))).withColumn("size", F.octet_length(F.coalesce("body", F.lit(""))))
    told = told.withColumn("body", F.when(F.col("outcome") == "ok", F.col("body")))
    return parse_robots_files(told, [*FILE, "outcome", "size"])


def rule_rows(parsed: DataFrame) -> DataFrame:
    """(origin, agent, allow, pattern, line); an agent without rules has one row of nulls."""
    rules = parsed.select(F.col("url").alias("origin"), F.explode("rules").alias("r")).select("origin", F.explode("r.agents").alias("agent"), "r.allow", "r.pattern", "r.line")
    named = parsed.select(F.col("url").alias("origin"), F.explode(F.array_distinct("agents")).alias("agent"))
    empty = named.join(rules.select("origin", "agent").distinct(), ["origin", "agent"], "left_anti")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("allow", "boolean"), ("pattern", "string"), ("line", "int"))]
    return rules.unionByName(empty.select("origin", "agent", *nothing))


def robots_part(parsed: DataFrame, start_url: str) -> DataFrame:
    agents = parsed.sparkSession.createDataFrame([(a,) for a in (*robots.AGENTS, PRODUCT)], "asked string")
    start = F.lit(start_url)
    asked = agents.select(robots_address(start).alias("origin"), "asked", request_path(start).alias("path"), start.alias("start"))
    return robots.robots_findings(parsed, robots.allowed(asked, robots.rules_for(rule_rows(parsed), asked)), PRODUCT)


def crawl_delays(parsed: DataFrame, agent: str = PRODUCT) -> DataFrame:
    """(url, seconds) of each robots.txt that asks ``agent`` to wait."""
    return parsed.select("url", robots.crawl_delay(F.col("agents"), F.col("delays"), agent).alias("seconds")).where("seconds is not null")


def disallowed_urls(urls: DataFrame, parsed: DataFrame, agent: str = PRODUCT) -> DataFrame:
    """(url): those that their robots.txt keeps ``agent`` from; where it is unavailable, all."""
    asked = urls.select("url").distinct().select("url", robots_address(F.col("url")).alias("origin"), F.lit(agent).alias("asked"), request_path(F.col("url")).alias("path"))
    shut = robots.allowed(asked, robots.rules_for(rule_rows(parsed), asked)).where("not allowed").select("url")
    down = asked.join(parsed.where("outcome in ('unavailable', 'blocked')").select(F.col("url").alias("origin")), "origin", "left_semi").select("url")
    return shut.union(down).distinct()


def sitemap_part(files: DataFrame, seeds: DataFrame, observed: DataFrame, parsed_robots: DataFrame) -> DataFrame:
    """``files``: url, status, error, body of every fetched sitemap; ``seeds``: site, url, source, declared;
    ``observed``: url, bad."""
    stored = parse_sitemap_files(files.withColumnRenamed("error", "fetch_error"), ["url", "status", "fetch_error"])
    failed = F.coalesce(F.when(F.coalesce("fetch_error", F.lit("")) != "", F.col("fetch_error")), F.when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP status "), F.col("status").cast("string"))))
    stored = stored.withColumn("invalid", F.col("invalid") & failed.isNull()).withColumn("kind", F.when(failed.isNull(), F.col("kind"))).withColumn("warnings", F.when(failed.isNull(), F.col("warnings")).otherwise(F.array().cast("array<string>"))).withColumn("error", F.coalesce(failed, "error"))
    reached = save(sitemaps.reached_files(stored, seeds))
    found = reached.where(F.col("k") <= sitemaps.MAX_FILES).drop("k")
    listed = sitemaps.listed_urls(found.where("error is null"))
    urls = sitemaps.sitemap_urls(listed)
    parts = sitemaps.sitemap_file_findings(found, listed).union(sitemaps.sitemap_limits(listed, sitemaps.skipped_files(reached)))
    return parts.union(sitemaps.bad_targets(urls, observed, disallowed_urls(urls, parsed_robots)))


def default_seed(start_url: str, spark) -> DataFrame:
    """/sitemap.xml of the start URL's site."""
    row = spark.createDataFrame([(start_url,)], "u string")
    return row.select(site_key(F.col("u")).alias("site"), F.concat(F.regexp_extract("u", r"^([a-z]+://[^/]+)", 1), F.lit("/sitemap.xml")).alias("url"), F.lit("default location").alias("source"), F.lit(False).alias("declared"))


def declared_seeds(parsed_robots: DataFrame) -> DataFrame:
    rows = parsed_robots.select("url", F.explode("sitemaps").alias("s"))
    return rows.select(site_key(F.col("url")).alias("site"), F.col("s.url").alias("url"), F.lit("robots.txt").alias("source"), F.lit(True).alias("declared"))
