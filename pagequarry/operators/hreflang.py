"""Alternates across pages: links back and targets that cannot be indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import finding, lines, spread


def declared(pages: DataFrame) -> DataFrame:
    """(url, target) for each declaration."""
    return pages.select("url", F.explode("hreflangs").alias("h")).select("url", F.col("h.href").alias("target"))


def without_return(pages: DataFrame) -> DataFrame:
    """(url, target): declarations of another parsed page that does not declare url."""
    rows = declared(pages).where("url <> target").join(pages.select(F.col("url").alias("target")).distinct(), "target", "left_semi")
    back = declared(pages).select(F.col("url").alias("target"), F.col("target").alias("url")).distinct()
    return rows.join(back, ["url", "target"], "left_anti").select("url", "target")


def hreflang_site_findings(pages: DataFrame) -> DataFrame:
    """``pages``: url, hreflangs, noindex."""
    hidden = pages.where("noindex").select(F.col("url").alias("target")).distinct()
    problem = declared(pages).where("url <> target").join(hidden, "target", "left_semi")
    own = lambda rows, rule: spread(rows, finding("metadata", rule, F.col("url"), lines(F.col("target"))))
    return own(without_return(pages), "SEO-HREFLANG-007").union(own(problem, "SEO-HREFLANG-006"))


def failed_alternates(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    failed = fetched.where("failed").select(F.col("url").alias("target")).distinct()
    rows = declared(pages).join(failed, "target", "left_semi")
    return spread(rows, finding("internal-linking", "SEO-HREFLANG-006", F.col("url"), lines(F.col("target"))))
