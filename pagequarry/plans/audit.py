"""A whole audit over a stored crawl: findings of every page and site, metrics, terms, scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import canonical, checks, duplicates, findings, hreflang, links, structured, terms
from ..operators.crawl import is_html
from ..sources.html import parse_pages
from ..storage import save
from . import site_files


@dataclass
class Audit:
    """Frames of an audit; findings have grp, id, url, evidence and the rule's columns."""

    pages: DataFrame
    findings: DataFrame
    metrics: DataFrame
    terms: DataFrame
    weak_terms: DataFrame
    scores: DataFrame
    crawl_delays: DataFrame | None = None


def audit(corpus: DataFrame, start_url: str, keywords: list[str] | None = None, robots_files: DataFrame | None = None, sitemap_files: DataFrame | None = None, other_fetches: DataFrame | None = None) -> Audit:
    """``corpus``: url (requested), depth, status, error, redirects, final_url, content_type, headers (map), html;
    ``robots_files``: url, final_url, status, error, body; ``sitemap_files``: url, status, error, body; ``other_fetches``:
    url, status, error, redirects, final_url of external links and of the start URL over http.

    One site.  HTML is parsed once and written; every analysis reads the parsed columns that it needs."""
    fetched = corpus.select("url", "depth", "status", F.coalesce("error", F.lit("")).alias("error"), "redirects", "final_url", "content_type", "headers")
    fetched = fetched.withColumn("failed", (F.col("error") != "") | (F.col("status") >= 400))
    readable = corpus.where((F.coalesce("error", F.lit("")) == "") & is_html(F.col("status"), F.col("content_type")) & F.col("html").isNotNull())
    parsed = parse_pages(readable.withColumn("requested", F.col("url")).withColumn("page_url", F.col("final_url")), ["requested", "depth"], url="page_url", headers="headers")
    pages = checks.with_robots(parsed).withColumn("indexable", ~F.col("noindex")).withColumn("is_start", F.col("requested") == start_url).withColumn("canonical", checks.canonical_url())
    pages = save(pages)
    start_final = pages.where("is_start").select("url").first()
    indexable = pages.where("indexable")
    n = indexable.count()

    observed = fetched.join(pages.select(F.col("requested").alias("url"), "canonical"), "url", "left")
    http = findings.spread(
        fetched.join(pages.select(F.col("requested").alias("url"), F.lit(True).alias("parsed")), "url", "left"),
        findings.finding("crawlability", "SEO-HTTP-001", F.col("url"), findings.lines(F.format_string("status: %d; error: %s", F.coalesce("status", F.lit(0)), F.col("error"))), F.col("failed")),
        findings.finding("crawlability", "SEO-HTTP-002", F.col("url"), findings.lines(F.col("final_url")), F.col("redirects") > 0),
        findings.finding("crawlability", "SEO-HTTP-003", F.col("url"), when=F.col("parsed").isNull() & (F.col("error") == "") & is_html(F.col("status"), F.col("content_type"))),
    )
    hygiene = fetched.where("status > 0").select(F.coalesce("final_url", "url").alias("url"), "headers", "depth").withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    # In the link graph a parsed page stands where its redirects ended, any other fetch where it began.
    in_graph = pages.select("url", F.lit(False).alias("failed")).union(fetched.join(pages.select(F.col("requested").alias("url")), "url", "left_anti").select("url", "failed"))
    text = indexable.select("url", F.col("main_text").alias("text"))
    counts = save(terms.term_counts(text, "url", "text"))
    exact = duplicates.exact_groups(text, "url", "text")
    near = duplicates.near_groups(save(duplicates.document_simhash(duplicates.representatives(text, "url", "text"), "url")), "url")
    group = lambda rows, rule: findings.spread(duplicates.listed(rows), findings.finding("content", rule, F.col("representative"), F.col("duplicates"), total=F.col("n")))
    common = findings.spread(terms.common_terms(counts, F.lit(n)), findings.finding("content", "SEO-TERMS-001", F.lit(""), findings.lines(F.concat("term", F.lit(" (site strength "), "strength", F.lit(")")))))
    specific = findings.spread(terms.page_specific(counts, "url"), findings.finding("content", "SEO-TERMS-002", F.col("url"), F.col("terms")))
    profile = findings.spread(terms.duplicate_profiles(counts, "url"), findings.finding("content", "SEO-TERMS-003", F.col("url")))

    parts = [
        http,
        canonical.canonical_site_findings(pages.select("url", "canonical"), observed),
        checks.metadata_findings(pages),
        checks.heading_findings(pages),
        checks.canonical_findings(pages),
        checks.robots_findings(pages, start_final["url"] if start_final else None),
        checks.language_findings(pages),
        checks.hreflang_conflicts(pages),
        hreflang.hreflang_site_findings(pages),
        checks.social_findings(pages),
        checks.image_findings(pages),
        checks.anchor_findings(pages),
        checks.shared_metadata(pages),
        checks.content_findings(indexable),
        group(exact, "SEO-DUPLICATE-001"),
        group(near, "SEO-DUPLICATE-002"),
        common,
        specific,
        profile,
        structured.structured_findings(pages),
        links.link_findings(pages, in_graph),
        links.failed_images(pages, fetched),
        hreflang.failed_alternates(pages, fetched),
        checks.hygiene_findings(hygiene, "depth"),
        checks.mixed_content(pages),
    ]
    if other_fetches is not None:
        parts += [links.external_findings(pages, other_fetches), checks.upgrade_findings(start_url, other_fetches)]
    delays = None
    if robots_files is not None:
        parsed_robots = save(site_files.read_robots(robots_files))
        delays = site_files.crawl_delays(parsed_robots)
        parts.append(site_files.robots_part(parsed_robots, start_url))
        if sitemap_files is not None:
            own = F.coalesce("canonical", F.lit(""))
            noindex = pages.select(F.col("requested").alias("url"), F.col("url").alias("page_url"), "noindex")
            state = observed.join(noindex, "url", "left")
            bad = F.col("failed") | (F.col("redirects") > 0) | F.coalesce("noindex", F.lit(False)) | ((own != "") & (own != F.col("page_url")))
            seeds = site_files.declared_seeds(parsed_robots).union(site_files.default_seed(start_url, corpus.sparkSession))
            parts.append(site_files.sitemap_part(sitemap_files, seeds, state.select("url", F.coalesce(bad, F.lit(False)).alias("bad")), parsed_robots))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = findings.with_rules(save(found))

    zones = indexable.select("url", F.coalesce(F.get("titles", F.lit(0)), F.lit("")).alias("title"), F.coalesce(F.get("descriptions", F.lit(0)), F.lit("")).alias("description"), F.array_join(F.transform("headings", lambda h: h["text"]), " ").alias("headings"), F.col("main_text").alias("body"))
    weighed = save(terms.weights(terms.zone_counts(zones), "url", F.lit(n)))
    site = save(terms.site_weights(weighed, F.lit(n)))
    strong = terms.site_strengths(site)
    top = terms.with_keywords(terms.top_terms(strong), strong, keywords or [])
    metrics = links.link_metrics(pages).join(pages.select("url", "depth", "indexable").dropDuplicates(["url"]), "url")
    return Audit(pages, found, metrics, top.select("term", "strength"), terms.weak_terms(terms.weak_candidates(site)), findings.scores(found, n), delays)
