"""The internal link graph of each site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import save
from .findings import finding, lines, spread


def link_rows(pages: DataFrame) -> DataFrame:
    """(site, source, pos, target, external, resource, nofollow, anchor, indexable): a page's first link to each target.

    A page's links lie in its own row, so the first of each target is found there.  Only the links of a URL that several
    rows have are dealt out and ranked."""
    places = F.transform("links", lambda x: x["url"])
    numbered = F.transform("links", lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    first = F.filter(numbered, lambda l: (l["x"]["url"] != "") & (F.array_position(places, l["x"]["url"]) == l["pos"] + 1))
    rows = lambda some: some.select("site", F.col("url").alias("source"), "indexable", F.explode(first).alias("l")).select("site", "source", "l.pos", F.col("l.x.url").alias("target"), "l.x.external", "l.x.resource", "l.x.nofollow", "l.x.anchor", "indexable")
    again = save(pages.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("url"))
    if not again.limit(1).count():
        return rows(pages)
    k = F.row_number().over(Window.partitionBy("source", "target").orderBy("pos"))
    ranked = rows(pages.join(again, "url", "left_semi")).withColumn("k", k).where("k = 1").drop("k")
    return rows(pages.join(again, "url", "left_anti")).union(ranked)


def inbound(links: DataFrame, fetched: DataFrame) -> DataFrame:
    """(url, n): links from other indexable pages, not nofollow, to fetched pages."""
    good = links.where("not external and not nofollow and indexable and source <> target")
    counts = good.groupBy(F.col("target").alias("url")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(fetched.select("url").distinct(), "url", "left_semi")


def orphans(pages: DataFrame, links: DataFrame, fetched: DataFrame) -> DataFrame:
    """Indexable pages other than the start that no indexable page links to; ``pages`` has is_start."""
    lone = pages.where("indexable and not is_start").join(inbound(links, fetched), "url", "left_anti")
    return spread(lone, finding("internal-linking", "SEO-LINK-001", F.col("url")))


def self_links(pages: DataFrame) -> DataFrame:
    own = F.filter("links", lambda x: x["url"] == F.col("url"))
    return spread(pages, finding("internal-linking", "SEO-LINK-002", F.col("url"), F.transform(own, lambda x: x["url"]), F.size(own) > 0))


def broken_targets(links: DataFrame, fetched: DataFrame) -> DataFrame:
    """(target): linked inside the site and fetched without success."""
    failed = fetched.where("failed").select(F.col("url").alias("target")).distinct()
    return links.where("not external").select("target").distinct().join(failed, "target", "left_semi")


def anchor_targets(links: DataFrame, fetched: DataFrame) -> DataFrame:
    """(site, anchor, targets): link texts that lead indexable pages of a site to two or more fetched targets."""
    rows = links.where("not external and indexable and trim(anchor) <> ''").select("site", F.lower("anchor").alias("anchor"), "target").distinct()
    led = rows.join(fetched.select(F.col("url").alias("target")).distinct(), "target", "left_semi")
    return led.groupBy("site", "anchor").agg(F.count(F.lit(1)).alias("targets")).where("targets >= 2")


def link_findings(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    rows = link_rows(pages)
    broken = spread(broken_targets(rows, fetched), finding("internal-linking", "SEO-LINK-004", F.lit(""), lines(F.col("target"))))
    told = F.format_string('anchor "%s" points to %d pages', F.regexp_replace("anchor", '"', '""'), F.col("targets"))
    reused = spread(anchor_targets(rows, fetched), finding("internal-linking", "SEO-LINK-003", F.lit(""), lines(told)))
    return orphans(pages, rows, fetched).union(self_links(pages)).union(broken).union(reused)


def link_metrics(pages: DataFrame) -> DataFrame:
    """(url, inbound, outbound): distinct internal links, not nofollow; inbound from indexable pages, fetched or not."""
    rows = link_rows(pages).where("not external and not nofollow and source <> target")
    into = rows.where("indexable").groupBy(F.col("target").alias("url")).agg(F.count(F.lit(1)).alias("inbound"))
    out = rows.groupBy(F.col("source").alias("url")).agg(F.count(F.lit(1)).alias("outbound"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pages.select("url").distinct().join(into, "url", "left").join(out, "url", "left").select("url", zero("inbound"), zero("outbound"))


MAX_EXTERNAL = 100


def external_urls(pages: DataFrame, most: int = MAX_EXTERNAL) -> DataFrame:
    """The ``most`` distinct external targets that come first, by the page's depth and URL and the link's place."""
    rows = pages.select("depth", F.col("url").alias("page"), F.posexplode("links").alias("pos", "x")).where("x.external and x.url <> ''")
    first = rows.groupBy(F.col("x.url").alias("url")).agg(F.min(F.struct("depth", "page", "pos")).alias("at"))
    return first.orderBy("at", "url").limit(most).select("url")


def external_findings(pages: DataFrame, log: DataFrame) -> DataFrame:
    """External targets that ``log`` (url, status, error) shows to fail; targets that it lacks were not asked for."""
    failed = log.where((F.coalesce("error", F.lit("")) != "") | (F.col("status") >= 400)).select("url").distinct()
    return spread(external_urls(pages).join(failed, "url", "left_semi"), finding("internal-linking", "SEO-LINK-008", F.col("url")))


def failed_images(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    images = pages.select("url", F.explode("images").alias("i")).select("url", F.col("i.src").alias("src"))
    broken = images.join(fetched.where("failed").select(F.col("url").alias("src")).distinct(), "src", "left_semi")
    return spread(broken, finding("internal-linking", "SEO-LINK-004", F.col("url"), lines(F.concat(F.lit("image: "), F.col("src")))))
