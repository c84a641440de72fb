"""Findings of single pages, as expressions over the parsed page struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_bytes, tokens
from ..functions.urls import site_key
from .findings import finding, lines, spread

# Guideline lengths, limits and directive names.
TITLE, DESCRIPTION, MIN_TOKENS, MIN_MAIN_SHARE = (15, 65), (50, 160), 40, 0.05
DIRECTIVES = """index noindex follow nofollow none all noarchive nocache nosnippet noimageindex notranslate indexifembedded noodp noydir""".split()
PREVIEWS = ["none", "standard", "large"]


def quoted(x: Column) -> Column:
    """In double quotes, with backslash escapes."""
    escaped = F.regexp_replace(F.regexp_replace(x, r"([\\\"])", r"\\$1"), "\n", r"\\n")
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _first(array: str) -> Column:
    return F.get(F.col(array), F.lit(0))


# ---------------------------------------------------------------- metadata and headings


def metadata_findings(pages: DataFrame) -> DataFrame:
    url, title, text = F.col("url"), _first("titles"), _first("descriptions")
    n, m = F.char_length(title), F.char_length(text)
    length = F.concat(n.cast("string"), F.lit(" characters: "), quoted(title))
    own = lambda rule, evidence=None, when=None: finding("metadata", rule, url, evidence, when)
    return spread(
        pages,
        own("SEO-TITLE-001", when=F.size("titles") == 0),
        own("SEO-TITLE-002", when=title == ""),
        own("SEO-TITLE-005", lines(length), (n > 0) & (n < TITLE[0])),
        own("SEO-TITLE-006", lines(length), n > TITLE[1]),
        own("SEO-TITLE-003", F.transform("titles", quoted), F.size("titles") > 1),
        own("SEO-DESC-001", when=F.size("descriptions") == 0),
        own("SEO-DESC-002", when=text == ""),
        own("SEO-DESC-005", lines(F.concat(m.cast("string"), F.lit(" characters (guideline 50-160)"))), (m > 0) & ~m.between(*DESCRIPTION)),
        own("SEO-DESC-003", F.transform("descriptions", quoted), F.size("descriptions") > 1),
    )


def heading_findings(pages: DataFrame) -> DataFrame:
    url, main = F.col("url"), F.filter("headings", lambda h: h["level"] == 1)
    numbered = F.transform("headings", lambda h, i: F.struct(h["level"].alias("level"), h["text"].alias("text"), (i + 1).alias("at"), F.when(i > 0, F.get(F.col("headings"), i - 1)["level"]).alias("before")))
    empty = F.transform(F.filter(numbered, lambda h: h["text"] == ""), lambda h: F.format_string("no text in h%d, heading %d of the page", h["level"], h["at"]))
    skips = F.filter(numbered, lambda h: F.when(h["before"].isNull(), h["level"] > 1).otherwise(h["level"] > h["before"] + 1))
    told = F.transform(skips, lambda h: F.when(h["before"].isNull(), F.format_string("first heading is h%d", h["level"])).otherwise(F.format_string("h%d right after h%d", h["level"], h["before"])))
    return spread(
        pages,
        finding("metadata", "SEO-HEADING-001", url, when=F.size(main) == 0),
        finding("metadata", "SEO-HEADING-002", url, F.transform(main, lambda h: quoted(h["text"])), F.size(main) > 1),
        finding("metadata", "SEO-HEADING-003", url, empty, F.size(empty) > 0),
        finding("metadata", "SEO-HEADING-004", url, told, F.size(told) > 0),
    )


def sharing(pages: DataFrame, value: Column) -> DataFrame:
    """(site, url, value, others, evidence) of each page of a site whose non-empty value another page has too.

    ``others`` counts all pages of another URL; ``evidence`` is the value and those of the first 21 pages by URL, so a value
    on any number of pages stays small."""
    rows = pages.select("site", "url", value.alias("value")).where("value <> ''")
    urls = rows.groupBy("site", "value", "url").agg(F.count(F.lit(1)).alias("same"))
    groups = urls.groupBy("site", "value").agg(F.sum("same").alias("n")).where("n > 1")
    members = rows.join(groups, ["site", "value"])
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("site", "value").orderBy("url")))
    heads = ranked.where("rank <= 21").groupBy("site", "value").agg(F.sort_array(F.collect_list("url")).alias("heads"))
    joined = members.join(heads, ["site", "value"]).join(urls, ["site", "value", "url"])
    told = F.transform(F.filter("heads", lambda u: u != F.col("url")), lambda u: F.concat(F.lit("also on "), u))
    return joined.select("site", "url", "value", (F.col("n") - F.col("same")).alias("others"), F.concat(lines(quoted(F.col("value"))), told).alias("evidence"))


def shared_values(pages: DataFrame, value: Column, rule: str) -> DataFrame:
    """A finding for each page of a site whose non-empty value another page has too; evidence names the first others and
    tells how many more there are."""
    return spread(sharing(pages, value), finding("metadata", rule, F.col("url"), F.col("evidence"), total=F.col("others") + 1))


def first_h1() -> Column:
    return F.lower(F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"])


def shared_metadata(pages: DataFrame) -> DataFrame:
    return shared_values(pages, _first("titles"), "SEO-TITLE-004").union(shared_values(pages, _first("descriptions"), "SEO-DESC-004")).union(shared_values(pages, first_h1(), "SEO-HEADING-005"))


# ---------------------------------------------------------------- canonical, robots


def canonical_url() -> Column:
    return F.coalesce(F.get(F.filter("canonicals", lambda c: (c["url"] != "") & c["in_head"]), F.lit(0))["url"], F.lit(""))


def canonical_findings(pages: DataFrame) -> DataFrame:
    url, n = F.col("url"), F.size("canonicals")
    line = lambda c: F.concat(c["source"], F.lit(": "), c["href"])
    targets = F.array_distinct(F.filter(F.transform("canonicals", lambda c: c["url"]), lambda u: u != ""))
    bad = F.filter("canonicals", lambda c: c["error"].isNotNull())
    relative = F.filter("canonicals", lambda c: c["error"].isNull() & c["relative"])
    outside = F.filter("canonicals", lambda c: c["error"].isNull() & ~c["in_head"])
    effective = canonical_url()
    own = lambda rule, evidence, when: finding("metadata", rule, url, evidence, when)
    return spread(
        pages,
        own("SEO-CANONICAL-001", lines(), n == 0),
        own("SEO-CANONICAL-002", F.transform("canonicals", line), (F.size(targets) > 1) | ((F.size(bad) > 0) & (n > 1))),
        own("SEO-CANONICAL-004", F.transform(bad, lambda c: F.concat(line(c), F.lit(" ("), c["error"], F.lit(")"))), F.size(bad) > 0),
        own("SEO-CANONICAL-003", F.transform(relative, lambda c: F.concat(line(c), F.lit(" -> "), c["url"])), F.size(relative) > 0),
        own("SEO-CANONICAL-005", F.transform(outside, line), F.size(outside) > 0),
        own("SEO-CANONICAL-006", lines(F.concat(F.lit("canonical: "), effective)), (effective != "") & (site_key(effective) != F.col("site"))),
    )


def with_robots(pages: DataFrame, sources: str = "robots") -> DataFrame:
    """Adds the folded directives of all agents and of googlebot, the most restrictive winning: noindex, nofollow,
    noarchive, nosnippet, explicit_index, explicit_follow, max_snippet, max_preview, bad_directives."""
    own = F.filter(sources, lambda s: s["agent"].isin("robots", "googlebot"))
    pieces = F.filter(F.transform(F.flatten(F.transform(own, lambda s: F.split(s["value"], ","))), lambda p: F.btrim(p)), lambda p: p != "")
    pairs = F.transform(pieces, lambda p: F.struct(F.lower(F.btrim(F.substring_index(p, ":", 1))).alias("key"), F.when(F.contains(p, F.lit(":")), F.btrim(F.regexp_replace(p, r"(?s)^[^:]*:", ""))).alias("arg"), p.alias("raw")))
    pages = pages.withColumn("directives_", pairs)
    has = lambda *names: F.exists("directives_", lambda d: d["key"].isin(*names))
    whole = lambda d: F.when(d["arg"].rlike(r"^[+-]?[0-9]{1,9}$"), d["arg"].cast("int"))
    numbered = lambda d: d["key"].isin("max-snippet", "max-video-preview")
    good = lambda d: F.coalesce(F.when(numbered(d), whole(d) >= -1).when(d["key"] == "max-image-preview", F.lower(d["arg"]).isin(PREVIEWS)).when(d["key"] == "unavailable_after", d["arg"] != "").otherwise(d["key"].isin(DIRECTIVES)), F.lit(False))
    lengths = F.transform(F.filter("directives_", lambda d: (d["key"] == "max-snippet") & good(d)), whole)
    limits = F.filter(lengths, lambda x: x > -1)
    shown = F.transform(F.filter("directives_", lambda d: (d["key"] == "max-image-preview") & good(d)), lambda d: F.array_position(F.array(*map(F.lit, PREVIEWS)), F.lower(d["arg"])))
    return (
        pages.withColumn("noindex", has("noindex", "none"))
        .withColumn("nofollow", has("nofollow", "none"))
        .withColumn("noarchive", has("noarchive", "nocache"))
        .withColumn("nosnippet", has("nosnippet"))
        .withColumn("explicit_index", has("index", "all"))
        .withColumn("explicit_follow", has("follow", "all"))
        .withColumn("max_snippet", F.when(F.size(limits) > 0, F.array_min(limits)).when(F.size(lengths) > 0, -1))
        .withColumn("max_preview", F.get(F.array(*map(F.lit, PREVIEWS)), F.array_min(shown).cast("int") - 1))
        .withColumn("bad_directives", F.transform(F.filter("directives_", lambda d: ~good(d)), lambda d: d["raw"]))
        .drop("directives_")
    )


def robots_findings(pages: DataFrame, start_url: str | None = None) -> DataFrame:
    """``pages`` as of ``with_robots``."""
    url = F.col("url")
    sources = F.transform("robots", lambda s: F.concat(s["source"], F.lit(" "), s["agent"], F.lit(": "), s["value"]))
    start = url.eqNullSafe(F.lit(start_url))
    shown = F.array_compact(F.array(F.when(F.col("nosnippet"), "nosnippet"), F.when(F.col("max_snippet") == 0, "max-snippet:0"), F.when(F.col("max_preview") == "none", "max-image-preview:none"), F.when(F.col("noarchive"), "noarchive")))
    effective = canonical_url()
    own = lambda rule, evidence, when: finding("metadata", rule, url, evidence, when)
    return spread(
        pages,
        own("SEO-INDEX-006", sources, F.col("noindex") & start),
        own("SEO-INDEX-001", sources, F.col("noindex") & ~start),
        own("SEO-INDEX-002", sources, F.col("nofollow")),
        own("SEO-INDEX-003", sources, (F.col("noindex") & F.col("explicit_index")) | (F.col("nofollow") & F.col("explicit_follow"))),
        own("SEO-INDEX-004", F.transform("bad_directives", quoted), F.size("bad_directives") > 0),
        own("SEO-INDEX-005", shown, F.size(shown) > 0),
        own("SEO-INDEX-007", lines(F.concat(F.lit("canonical: "), effective)), F.col("noindex") & (effective != "") & (effective != url)),
    )


# ---------------------------------------------------------------- languages


def language_codes(spark) -> tuple[list[str], list[str]]:
    """ISO languages and countries, as the JVM knows them."""
    locale = spark.sparkContext._jvm.java.util.Locale
    return sorted(locale.getISOLanguages()), sorted(locale.getISOCountries())


def is_hreflang(value: Column, languages: list[str], countries: list[str]) -> Column:
    """x-default, or a language with, if any, a script and a country."""
    parts = F.split(value, "-")
    country = F.upper(F.regexp_extract(value, r"^[A-Za-z]{2}(?:-[A-Za-z]{4})?-([A-Za-z]{2})$", 1))
    shape = value.rlike(r"^[A-Za-z]{2}(-[A-Za-z]{4})?(-[A-Za-z]{2})?$")
    return (F.lower(value) == "x-default") | (shape & F.lower(parts[0]).isin(languages) & ((country == "") | (country.isin(countries) & (country != "UK"))))


def is_language_tag(value: Column, languages: list[str]) -> Column:
    head = F.lower(F.split(value, "-")[0])
    return value.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$") & (head != "und") & ((F.char_length(head) == 3) | head.isin(languages))


def language_findings(pages: DataFrame) -> DataFrame:
    languages, countries = language_codes(pages.sparkSession)
    url, lang = F.col("url"), F.col("lang")
    key = lambda h: F.lower(h["target"])
    head = lambda c: F.split(F.lower(c), "-")[0]
    keys = F.array_distinct(F.transform("hreflangs", key))
    own = F.filter("hreflangs", lambda h: (h["href"] == url) & (key(h) != "x-default"))
    invalid = F.transform(F.filter("hreflangs", lambda h: ~is_hreflang(h["target"], languages, countries)), lambda h: finding("metadata", "SEO-HREFLANG-003", url, lines(h["target"])))
    other = F.transform(F.filter(own, lambda h: lang.isNotNull() & (head(lang) != head(key(h)))), lambda h: finding("metadata", "SEO-LANG-003", url, lines(lang, h["target"])))
    some = F.size("hreflangs") > 0
    return spread(
        pages,
        finding("metadata", "SEO-HREFLANG-004", url, when=some & (F.size(own) == 0)),
        finding("metadata", "SEO-HREFLANG-005", url, when=(F.size(keys) > 1) & ~F.array_contains(keys, "x-default")),
        finding("metadata", "SEO-LANG-001", url, when=lang.isNull()),
        finding("metadata", "SEO-LANG-002", url, lines(lang), lang.isNotNull() & ~is_language_tag(lang, languages)),
        many=F.concat(invalid, other),
    )


def hreflang_conflicts(pages: DataFrame) -> DataFrame:
    """A language declared for another target than the time before on the page."""
    rows = pages.select("url", F.posexplode("hreflangs").alias("pos", "h")).select("url", "pos", F.lower("h.target").alias("key"), "h.href")
    before = F.lag("href").over(Window.partitionBy("url", "key").orderBy("pos"))
    found = rows.withColumn("before", before).where("before <> href")
    return spread(found, finding("metadata", "SEO-HREFLANG-002", F.col("url"), lines(F.col("key"), F.col("before"), F.col("href"))))


# ---------------------------------------------------------------- social, images, anchors


def social_findings(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    last = lambda name: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("social", lambda s: s["property"] == name), lambda s: s["value"])), -1)
    some = lambda name: F.coalesce(last(name), F.lit("")) != ""
    differ = [finding("metadata", "SEO-SOCIAL-002", url, lines(F.concat(F.lit(f"og:{x}: "), last(f"og:{x}")), F.concat(F.lit(f"twitter:{x}: "), last(f"twitter:{x}"))), last(f"og:{x}").isNotNull() & some(f"twitter:{x}") & (F.lower(last(f"og:{x}")) != F.lower(last(f"twitter:{x}")))) for x in ("title", "description")]
    bad = F.filter("social", lambda s: s["property"].isin("og:image", "twitter:image") & (s["value"] != "") & ~s["value"].rlike(r"^(?i)https?:(?://[^\s/]|/)"))
    has = lambda lead: F.exists("social", lambda s: s["property"].startswith(lead) & (F.char_length(s["property"]) > len(lead)))
    lacking = [F.when(has("og:") & ~some(f"og:{x}"), f"og:{x}") for x in ("title", "type", "url", "image")]
    lacking += [F.when(has("twitter:") & ~some("twitter:card"), "twitter:card")]
    lacking += [F.when(has("twitter:") & ~some(f"twitter:{x}") & ~some(f"og:{x}"), f"twitter:{x} or og:{x}") for x in ("title", "image")]
    missing = F.array_compact(F.array(*lacking))
    return spread(
        pages,
        *differ,
        finding("metadata", "SEO-SOCIAL-004", url, F.transform(bad, lambda s: F.concat(F.lit("og:image: "), s["value"])), F.size(bad) > 0),
        finding("metadata", "SEO-SOCIAL-005", url, missing, F.size(missing) > 0),
    )


def image_findings(pages: DataFrame) -> DataFrame:
    """One finding for each image and rule."""
    each = pages.select("url", F.explode("images").alias("i"))
    own = lambda rule, when, *ev: finding("metadata", rule, F.col("url"), lines(F.col("i.src"), *ev), when)
    return spread(
        each,
        own("SEO-IMAGE-001", ~F.col("i.has_alt")),
        own("SEO-IMAGE-002", (F.col("i.width") <= 0) | (F.col("i.height") <= 0)),
        own("SEO-IMAGE-003", ~F.col("i.loading").isin("", "lazy", "eager"), F.col("i.loading")),
    )


def anchor_findings(pages: DataFrame) -> DataFrame:
    internal = F.filter("links", lambda x: ~x["external"] & ~x["resource"])
    bare = F.transform(F.filter(internal, lambda x: x["anchor"] == ""), lambda x: F.concat(F.lit("to "), cut_bytes(x["url"], 120)))
    empty = spread(pages, finding("metadata", "SEO-ANCHOR-001", F.col("url"), bare, F.size(bare) > 0))
    reused = anchor_reuse(pages)
    told = F.format_string('"%s" used for %d links to %d pages', F.col("anchor"), F.col("n"), F.col("targets"))
    return empty.union(spread(reused, finding("metadata", "SEO-ANCHOR-002", F.col("url"), lines(told))))


def anchor_reuse(pages: DataFrame) -> DataFrame:
    """(url, anchor, n, targets): link texts of a page that reach two or more targets."""
    rows = pages.select("url", F.explode("links").alias("x")).where("not x.external and not x.resource and x.anchor <> ''")
    grouped = rows.groupBy("url", F.lower("x.anchor").alias("anchor")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x.url").alias("targets"))
    return grouped.where("targets >= 2")


# ---------------------------------------------------------------- content, hygiene


def content_findings(pages: DataFrame) -> DataFrame:
    url, n = F.col("url"), F.size(tokens(F.col("main_text")))
    share = F.octet_length("main_text") / F.col("text_bytes")
    counted = pages.withColumn("n_", n).withColumn("thin_", F.coalesce(F.when(F.col("text_bytes") > 0, share) < MIN_MAIN_SHARE, F.lit(True)))
    return spread(
        counted,
        finding("content", "SEO-CONTENT-003", url, when=F.col("n_") == 0),
        finding("content", "SEO-CONTENT-001", url, when=(F.col("n_") > 0) & F.col("thin_")),
        finding("content", "SEO-CONTENT-002", url, when=(F.col("n_") > 0) & (F.col("n_") < MIN_TOKENS)),
    )


def header(name: str) -> Column:
    """A header's value by name in any case, or an empty string; ``headers`` is a map."""
    hit = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.get(hit, F.lit(0))["value"], F.lit(""))


def hygiene_findings(fetches: DataFrame, order: str | None = None) -> DataFrame:
    """``fetches``: url (final), headers.  Of rows of one URL the first counts."""
    if order:
        fetches = fetches.withColumn("k_", F.row_number().over(Window.partitionBy("url").orderBy(order))).where("k_ = 1")
    url = F.col("url")
    secure = F.lower(url).startswith("https://")
    hsts, sniff, csp = header("strict-transport-security"), header("x-content-type-options"), header("content-security-policy")
    value = lambda h: lines(F.when(h == "", "missing").otherwise(F.concat(F.lit("value: "), h)))
    own = lambda rule, when, ev=None: finding("web-hygiene", rule, url, ev, when)
    return spread(
        fetches,
        own("WEB-HYGIENE-001", ~secure),
        own("WEB-HYGIENE-006", secure & ~F.contains(F.lower(hsts), F.lit("max-age")), value(hsts)),
        own("WEB-HYGIENE-002", F.lower(sniff) != "nosniff", value(sniff)),
        own("WEB-HYGIENE-003", header("referrer-policy") == ""),
        own("WEB-HYGIENE-007", F.btrim(csp) == ""),
        own("WEB-HYGIENE-008", (F.btrim(header("x-frame-options")) == "") & ~F.contains(F.lower(csp), F.lit("frame-ancestors"))),
    )


def upgrade_findings(start_url: str, log: DataFrame) -> DataFrame:
    """Does the http form of an https start URL lead to https?  ``log``: url, status, error, redirects, final_url."""
    plain = "http" + start_url.removeprefix("https")
    rows = log.sparkSession.createDataFrame([(start_url, plain)] if start_url.startswith("https:") else [], "start string, plain string")
    asked = rows.join(log.where(F.col("url") == plain).dropDuplicates(["url"]).withColumnRenamed("url", "plain"), "plain", "left")
    unknown = F.col("status").isNull() | (F.coalesce("error", F.lit("")) != "")
    stays = (F.coalesce("redirects", F.lit(0)) == 0) | ~F.coalesce("final_url", F.lit("")).startswith("https:")
    told = lines(F.when(unknown, "no answer over http").otherwise(F.coalesce("final_url", "plain")))
    return spread(asked, finding("web-hygiene", "WEB-HYGIENE-004", F.col("start"), told, unknown | stays))


def mixed_content(pages: DataFrame) -> DataFrame:
    return spread(pages, finding("web-hygiene", "WEB-HYGIENE-005", F.col("url"), F.col("mixed"), F.size("mixed") > 0))
