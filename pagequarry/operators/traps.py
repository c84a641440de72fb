"""Crawler traps: URLs that would be crawled for ever."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import MAX_URL_BYTES, path_of, query_of, url_pattern

MAX_SEGMENTS, MAX_REPEATS, MAX_QUERIES, MAX_PATTERN = 30, 3, 25, 100


def static_trap(url: Column) -> Column:
    """The reason that the URL alone gives, or null: length, number of segments, a segment that repeats too often."""
    bare = F.regexp_replace(path_of(url), "^/+|/+$", "")
    segments = F.split(bare, "/")
    filled = F.filter(segments, lambda s: s != "")
    often = F.exists(F.array_distinct(filled), lambda s: F.size(F.filter(filled, lambda t: t == s)) > MAX_REPEATS)
    return F.when(F.octet_length(url) > MAX_URL_BYTES, "url-too-long").when(F.size(segments) > MAX_SEGMENTS, "too-many-path-segments").when(often, "repeated-path-segment")


def admitted(urls: DataFrame, url: str, order: list[str]) -> DataFrame:
    """``urls`` (distinct per site, column site) with ``trap``: null where the guard admits the URL.

    In order, a site admits up to MAX_QUERIES URLs with a query for each path and up to MAX_PATTERN URLs of a
    pattern.  The path limit is a row number; refused URLs do not count towards a pattern, so the pattern limit is
    a row number among those that pass the first test."""
    base = urls.withColumn("trap_", static_trap(F.col(url))).withColumn("path_", path_of(F.col(url))).withColumn("query_", query_of(F.col(url))).withColumn("pattern_", url_pattern(F.col(url)))
    open_ = F.col("trap_").isNull()
    pattern = Window.partitionBy("site", "pattern_", open_ & F.col("ok_")).orderBy(*order)
    path = Window.partitionBy("site", "path_", open_ & (F.col("query_") != "")).orderBy(*order)
    ranked = base.withColumn("ok_", (F.col("query_") == "") | (F.row_number().over(path) <= MAX_QUERIES))
    ranked = ranked.withColumn("n_", F.row_number().over(pattern))
    trap = F.coalesce("trap_", F.when(~F.col("ok_"), "query-explosion"), F.when(F.col("n_") > MAX_PATTERN, "path-pattern-explosion"))
    return ranked.withColumn("trap", trap).drop("trap_", "path_", "query_", "pattern_", "ok_", "n_")
