"""Canonical targets, chains and loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import save
from .findings import finding, lines, spread

MAX_HOPS = 20


def target_states(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """(url, canonical, state, detail) of pages that name another page that was fetched; state: error, status, redirect, ok.

    ``pages``: url, canonical; ``fetched``: url, status, error, redirects, final_url."""
    asked = pages.where("canonical <> '' and canonical <> url")
    f = fetched.select(F.col("url").alias("canonical"), "status", "error", "redirects", "final_url")
    state = F.when(F.coalesce("error", F.lit("")) != "", "error").when(F.col("status") >= 400, "status").when(F.col("redirects") > 0, "redirect").otherwise("ok")
    detail = F.when(state == "error", F.concat(F.lit("error: "), F.col("error"))).when(state == "status", F.concat(F.lit("HTTP status "), F.col("status").cast("string"))).when(state == "redirect", F.concat(F.lit("redirects to "), F.col("final_url")))
    return asked.join(f, "canonical").select("url", "canonical", state.alias("state"), detail.alias("detail"))


def chains(starts: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(url, path, loops): canonicals followed from each (url, canonical) of ``starts``.

    ``edges`` (url, canonical) has a row for each fetched URL, canonical empty where it has none.  A walk ends at a page
    that is not fetched, has no canonical or names itself, and at the first URL seen before (loops).  Each step is an
    equi-join of the open walks; walks are as many as pages, and stop after max_hops."""
    walks = starts.select("url", F.array("url", "canonical").alias("path"), F.lit(False).alias("loops"))
    step = edges.select(F.col("url").alias("at"), F.col("canonical").alias("next"))
    done = None
    for _ in range(max_hops):
        here = walks.withColumn("at", F.element_at("path", -1)).join(step, "at", "left")
        ends = F.coalesce("next", F.lit("")).isin("") | (F.col("next") == F.col("at"))
        seen = F.array_contains("path", F.col("next"))
        finished = here.where(ends | seen).select("url", F.when(~ends, F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"), (~ends).alias("loops"))
        done = finished if done is None else done.union(finished)
        walks = here.where(~ends & ~seen).select("url", F.concat("path", F.array("next")).alias("path"), F.lit(False).alias("loops"))
        walks = save(walks)
        if walks.limit(1).count() == 0:
            return done
    return done.union(walks)


def canonical_site_findings(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """``pages``: url, canonical; ``fetched`` as for ``target_states``, with canonical."""
    states = target_states(pages, fetched)
    line = F.concat(F.lit("canonical: "), F.col("canonical"))
    own = lambda rule, when: finding("crawlability", rule, F.col("url"), lines(line, F.col("detail")), when)
    bad = spread(states, own("SEO-CANONICAL-007", F.col("state").isin("error", "status")), own("SEO-CANONICAL-008", F.col("state") == "redirect"))
    walked = chains(states.where("state = 'ok'").select("url", "canonical"), fetched.select("url", F.coalesce("canonical", F.lit("")).alias("canonical")))
    told = lines(F.array_join("path", " -> "))
    more = spread(walked, finding("crawlability", "SEO-CANONICAL-009", F.col("url"), told, F.col("loops")), finding("crawlability", "SEO-CANONICAL-010", F.col("url"), told, ~F.col("loops") & (F.size("path") > 2)))
    return bad.union(more)
