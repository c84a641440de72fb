import datetime
import json

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import checks, crawl, duplicates, findings, network, robots, sitemaps, structured, terms, traps
from pagequarry.plans.audit import audit
from pagequarry.plans.report import build_report, compare, exit_code, highlights, is_unchanged, render, store
from pagequarry.sources.reports import load_report, report_findings
from pagequarry.streaming.fetch_log import windowed_tallies

LONG = " ".join(f"word{i} topic{i % 7} gravel" for i in range(60))
SCHEMA = "url string, depth int, status int, error string, redirects int, final_url string, content_type string, headers map<string,string>, html string"


def page(title, body, head="", lang="en"):
    return f"<html lang={lang}><head><title>{title}</title>{head}</head><body><main><h1>{title}</h1>{body}</main></body></html>"


@pytest.fixture(scope="module")
def site(spark):
    u = "https://s.test"
    ok = lambda path, depth, html: (u + path, depth, 200, "", 0, u + path, "text/html; charset=utf-8", {"Referrer-Policy": "x"}, html)
    desc = "<meta name=description content='A description that is certainly long enough to be fine for search.'>"
    rows = [
        ok("/", 0, page("The start page of the site", f"<p>{LONG}<a href=/a>to a</a><a href=/b>to b</a><a href=/gone>lost</a><a href=/dup1>d</a><a href=/dup2>d</a>", desc + "<link rel=canonical href=https://s.test/>")),
        ok("/a", 1, page("A page with its own title", f"<p>{LONG} more alpha text<a href=/a>self</a><img src=/i.png>", "<meta name=robots content='noindex,index'><link rel=canonical href=/c1>")),
        ok("/b", 1, page("Short", "<p>tiny", "<link rel=alternate hreflang=de href=/a><link rel=alternate hreflang=en-UK href=/b>")),
        ok("/dup1", 1, page("One title for two pages", "<p>" + LONG.replace("gravel", "pebble"))),
        ok("/dup2", 1, page("One title for two pages", "<p>" + LONG.replace("gravel", "pebble"))),
        ok("/orphan", 1, page("Nobody links to this one", f"<p>{LONG} extra orphan")),
        (u + "/gone", 1, 404, "", 0, u + "/gone", "text/html", None, "<p>not found"),
        (u + "/old", 1, 200, "", 1, u + "/new", "text/html", {}, page("The page that moved away", f"<p>{LONG} moved")),
        (u + "/dead", 1, 0, "timeout", 0, "", "", None, None),
        (u + "/c1", 1, 200, "", 0, u + "/c1", "text/html", {}, page("First link of the chain", "<p>" + LONG + " chain one", "<link rel=canonical href=/c2>")),
        (u + "/c2", 1, 200, "", 0, u + "/c2", "text/html", {}, page("Second link of the chain", "<p>" + LONG + " chain two", "<link rel=canonical href=/c1>")),
        (u + "/file.pdf", 1, 200, "", 0, u + "/file.pdf", "application/pdf", {}, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def result(site, spark):
    robots_txt = "User-agent: *\nCrawl-delay: 2\nDisallow: /b\nDisallow: /$\nUser-agent: bingbot\nSitemap: https://s.test/m.xml\nSitemap: rel.xml\nwrong"
    files = spark.createDataFrame([("https://s.test/robots.txt", "https://s.test/robots.txt", 200, "", robots_txt)], "url string, final_url string, status int, error string, body string")
    listed = "".join(f"<url><loc>https://{x}</loc></url>" for x in ("s.test/a", "s.test/b", "s.test/dup1", "s.test/gone", "o.test/"))
    maps = spark.createDataFrame([("https://s.test/m.xml", 200, "", f"<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>{listed}</urlset>"), ("https://s.test/sitemap.xml", 404, "", None)], "url string, status int, error string, body string")
    return audit(site, "https://s.test/", ["gravel", "absent"], files, maps)


def test_robots_and_sitemap_findings(result):
    have = {(r["id"], r["url"].removeprefix("https://s.test"), tuple(r["evidence"])) for r in result.findings.where("id like 'SEO-ROBOTS%' or id like 'SEO-SITEMAP%'").collect()}
    ids = {(i, u) for i, u, _ in have}
    assert {("SEO-ROBOTS-003", "/"), ("SEO-ROBOTS-005", "/robots.txt"), ("SEO-ROBOTS-007", "/robots.txt"), ("SEO-SITEMAP-006", ""), ("SEO-SITEMAP-010", "/a"), ("SEO-SITEMAP-010", "/b"), ("SEO-SITEMAP-010", "/gone")} <= ids
    assert not {("SEO-ROBOTS-004", "/"), ("SEO-ROBOTS-006", "/robots.txt"), ("SEO-SITEMAP-001", ""), ("SEO-SITEMAP-010", "/dup1"), ("SEO-SITEMAP-002", "/sitemap.xml")} & ids
    assert ("SEO-SITEMAP-010", "/b", ("disallowed by robots.txt",)) in have


def test_findings_of_a_small_site(result):
    have = {(r["id"], r["url"].removeprefix("https://s.test")) for r in result.findings.collect()}
    want = {("SEO-HTTP-001", "/gone"), ("SEO-HTTP-001", "/dead"), ("SEO-HTTP-002", "/old"), ("SEO-INDEX-001", "/a"), ("SEO-INDEX-003", "/a"), ("SEO-INDEX-007", "/a"), ("SEO-TITLE-005", "/b"), ("SEO-TITLE-004", "/dup1"), ("SEO-TITLE-004", "/dup2"), ("SEO-HEADING-005", "/dup2"), ("SEO-DUPLICATE-001", "/dup1"), ("SEO-LINK-001", "/orphan"), ("SEO-LINK-002", "/a"), ("SEO-LINK-004", ""), ("SEO-CANONICAL-009", "/c1"), ("SEO-CANONICAL-009", "/c2"), ("SEO-CONTENT-002", "/b"), ("SEO-IMAGE-001", "/a"), ("SEO-HREFLANG-003", "/b"), ("SEO-HREFLANG-007", "/b"), ("SEO-HREFLANG-006", "/b"), ("WEB-HYGIENE-006", "/"), ("SEO-TERMS-001", "")}
    assert want <= have
    assert not {("SEO-LINK-001", "/"), ("SEO-TITLE-001", "/"), ("SEO-CANONICAL-001", "/"), ("SEO-DUPLICATE-001", "/dup2"), ("SEO-HTTP-003", "/file.pdf")} & have


def test_report_forms_and_comparison(result, spark, tmp_path):
    report = build_report(result, "https://s.test/")
    assert report["summary"]["pages"] == 9 and report["summary"]["highest_severity"] == "critical" and 0 <= report["scores"]["seo"] <= 100
    assert {t["term"] for t in report["terms"]} >= {"gravel", "absent"}
    assert report["crawl_delay_seconds"] == {"https://s.test/robots.txt": 2.0} and "asks for 2 seconds" in render(report)
    store(result, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "findings")).count() == sum(map(len, report["findings"].values()))
    for form in ("text", "detailed", "json", "html", "quick-wins"):
        assert "s.test" in render(report, form)
    assert "\x1b" not in render({**report, "summary": {**report["summary"], "start_url": "https://s.test/\x1b[31m"}})
    assert any("high" in w for w in highlights(report)[1])
    assert exit_code(report, "critical") == 1 and exit_code(report) == 0
    path = tmp_path / "r.json"
    path.write_text(render(report, "json"))
    loaded = report_findings(load_report(spark, str(path)))
    same = compare(result.findings, loaded, report, report)
    assert is_unchanged(same)
    diff = compare(result.findings, loaded.where("grp <> 'web-hygiene'"))
    assert diff["added_groups"] == ["web-hygiene"] and diff["new"] and not diff["resolved"]
    path.write_text(json.dumps({"schema_version": "9"}))
    with pytest.raises(ValueError):
        load_report(spark, str(path))


def test_evidence_limits(spark):
    rows = spark.createDataFrame([([f"line {i}" for i in range(25)] + ["x" * 400],), ([],)], "e array<string>")
    a, b = [r["e"] for r in rows.select(findings.limited(F.col("e")).alias("e")).collect()]
    assert len(a) == 21 and a[-1] == "... and 6 more" and b == []


def test_robots_precedence(spark):
    rules = [("o", "*", False, "/a*b$", 1), ("o", "*", True, "/a", 2), ("o", "x", False, "/(.)", 3)]
    df = spark.createDataFrame(rules, "origin string, agent string, allow boolean, pattern string, line int")
    asked = spark.createDataFrame([("o", "*", p) for p in ("/ab", "/aab", "/abc", "/zz", "")] + [("o", "x", "/(.)"), ("o", "x", "/q")], "origin string, asked string, path string")
    out = {(r["asked"], r["path"]): r["allowed"] for r in robots.allowed(asked, robots.rules_for(df, asked)).collect()}
    assert out == {("*", "/ab"): False, ("*", "/aab"): False, ("*", "/abc"): True, ("*", "/zz"): True, ("*", "/"): True, ("x", "/(.)"): False, ("x", "/q"): True}


def test_crawl_delays(spark):
    from pagequarry.plans import site_files
    from pagequarry.sources.robots import parse_robots_files

    texts = {"own": "User-agent: *\nCrawl-delay: 9\nUser-agent: Bot/2\nCrawl-delay: 1.5", "any": "User-agent: *\nCrawl-delay: 3", "named": "User-agent: *\nCrawl-delay: 3\nUser-agent: bot\nDisallow: /x", "none": "User-agent: *\nDisallow:"}
    parsed = parse_robots_files(spark.createDataFrame(list(texts.items()), "url string, body string"), ["url"])
    assert {r["url"]: r["seconds"] for r in site_files.crawl_delays(parsed, "bot").collect()} == {"own": 1.5, "any": 3.0}


def test_traps_and_crawl(spark):
    urls = [f"https://s.test/c/{i}" for i in range(150)]
    df = spark.createDataFrame([("s.test", u) for u in urls], "site string, url string")
    assert traps.admitted(df, "url", ["url"]).where("trap = 'path-pattern-explosion'").count() == 50
    links = [("s.test", "https://s.test/", "https://s.test/a"), ("s.test", "https://s.test/a", "https://s.test/b"), ("s.test", "https://s.test/b", "https://s.test/c"), ("s.test", "https://s.test/", "https://s.test/no")]
    start = spark.createDataFrame([("s.test", "https://s.test/")], "site string, url string")
    shut = spark.createDataFrame([("s.test", "https://s.test/no")], "site string, url string")
    pages, skipped = crawl.crawl(start, spark.createDataFrame(links, "site string, source string, target string"), max_depth=2, disallowed=shut)
    assert sorted((r["url"][-1], r["depth"]) for r in pages.collect()) == [("/", 0), ("a", 1), ("b", 2)]
    assert {(r["url"], r["reason"]) for r in skipped.collect()} == {("https://s.test/no", "robots-disallowed"), ("https://s.test/c", "max-depth")}


def test_trap_limits_hold_across_levels(spark):
    u = "https://s.test/"
    links = [("s.test", u, u + "hub")] + [("s.test", u, f"{u}c/{i}") for i in range(70)] + [("s.test", u + "hub", f"{u}c/{i}") for i in range(70, 150)]
    start = spark.createDataFrame([("s.test", u)], "site string, url string")
    pages, skipped = crawl.crawl(start, spark.createDataFrame(links, "site string, source string, target string"), max_depth=2)
    assert pages.count() == 102 and {(r["reason"], r["n"]) for r in crawl.skip_counts(skipped).collect()} == {("path-pattern-explosion", 50)}


def test_leader_groups_follow_key_order(spark):
    # 1-2, 2-3, 3-4: 2 joins 1, 3 leads, 4 joins 3; 10-11, 10-12
    pairs = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 4, 0), (10, 11, 0), (10, 12, 0)], "a long, b long, distance int")
    assert {(r[0], tuple(r[1])) for r in duplicates.listed(duplicates.leader_groups(pairs)).collect()} == {(1, (2,)), (3, (4,)), (10, (11, 12))}


def test_near_groups_follow_leaders_of_all_pages(spark):
    import random

    rng = random.Random(3)
    centres = [rng.getrandbits(63) for _ in range(6)]
    hashes = {}
    for key in range(150):
        h = rng.choice(centres)
        for _ in range(rng.choice([0, 0, 1, 3, 5, 7])):
            h ^= 1 << rng.randrange(63)
        hashes[key] = h
    leaders, want = [], set()
    for key, h in hashes.items():
        first = next((k for k in leaders if (hashes[k] ^ h).bit_count() <= 5), None)
        if first is None:
            leaders.append(key)
        else:
            want.add((first, key))
    df = spark.createDataFrame(list(hashes.items()), "id long, simhash long")
    assert {tuple(r) for r in duplicates.near_groups(df, "id").collect()} == want
    pairs = {(a, b): (hashes[a] ^ hashes[b]).bit_count() for a in hashes for b in hashes if a < b and (hashes[a] ^ hashes[b]).bit_count() <= 5}
    assert {(r["a"], r["b"]): r["distance"] for r in duplicates.near_pairs(df, "id").collect()} == pairs


def test_zone_weights(spark):
    pages = spark.createDataFrame([("u", "alpha", "beta", "gamma alpha", "alpha delta")], "url string, title string, description string, headings string, body string")
    assert {r["term"]: (r["n"], r["meta"], r["heading"]) for r in terms.zone_counts(pages).collect()} == {"alpha": (8, True, True), "beta": (2, True, False), "gamma": (3, False, True), "delta": (1, False, False)}


def test_sitemap_collection(spark):
    files = spark.createDataFrame([("https://s.test/i.xml", "sitemapindex", [("https://s.test/m.xml", ""), ("https://s.test/m.xml", "")]), ("https://s.test/m.xml", "urlset", [("https://s.test/p", "2024"), ("https://o.test/", ""), ("nope", "")])], "url string, kind string, entries array<struct<loc:string,lastmod:string>>")
    seeds = spark.createDataFrame([("s.test", "https://s.test/i.xml", "robots.txt", True)], "site string, url string, source string, declared boolean")
    found = sitemaps.collect_files(files, seeds)
    assert sorted((r["url"], r["depth"]) for r in found.collect()) == [("https://s.test/i.xml", 0), ("https://s.test/m.xml", 1)]
    reached = sitemaps.reached_files(files, seeds)
    assert [tuple(r) for r in sitemaps.skipped_files(reached, 1).collect()] == [("s.test", 1)]
    told = sitemaps.sitemap_limits(sitemaps.listed_urls(found), sitemaps.skipped_files(reached, 1), 0).first()
    assert told["id"] == "SEO-SITEMAP-008" and told["evidence"] == ["sitemap files not fetched: 1", "sitemap URLs not recorded: 1"]
    assert sitemaps.sitemap_limits(sitemaps.listed_urls(found), sitemaps.skipped_files(reached)).count() == 0
    listed = sitemaps.listed_urls(found)
    assert {r["state"] for r in listed.collect()} == {"ok", "out-of-scope", "invalid"} and sitemaps.sitemap_urls(listed).count() == 1


def test_addresses(spark):
    cases = {"::1": "loopback", "fe80::1": "link-local", "fd00:ec2::254": "metadata", "::ffff:10.0.0.1": "private", "64:ff9b::7f00:1": "loopback", "2002:a00:1::": "private", "2606:4700::1": "public", "4000::1": "reserved", "2001:db8::1": "reserved", "bad": "reserved", "8.8.8.8": "public", "169.254.169.254": "metadata", "fe80::1%eth0": "link-local"}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert {r["ip"]: r["ip_class"] for r in network.classify(df, "ip").collect()} == cases


def test_request_spacing(spark):
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 10, 20, 500, 505])], "k string, at long, id int")
    assert [r["start"] for r in network.spaced_starts(df, "k", "at", ["at", "id"], 100).orderBy("id").collect()] == [0, 100, 200, 500, 600]


def test_language_codes(spark):
    languages, countries = checks.language_codes(spark)
    values = {"en": True, "en-US": True, "x-default": True, "X-Default": True, "zh-Hant-TW": True, "en-UK": False, "eng": False, "pt_BR": False, "zz": False, "en-US-x": False, "": False}
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", checks.is_hreflang(F.col("v"), languages, countries).alias("ok"))
    assert {r["v"]: r["ok"] for r in df.collect()} == values


def test_stream_tallies(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i), i % 3, "fetch") for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "in"))
    q = windowed_tallies(stream).writeStream.outputMode("complete").format("memory").queryName("tallies").start()
    q.processAllAvailable()
    q.stop()
    assert [r["n"] for r in spark.sql("select n from tallies order by start").collect()] == [10, 10, 10]


def test_url_texts(spark):
    cases = {"/x": True, "a b": False, "": False, " https://h.test/ ": True, "ftp://x": False, "https:///x": False, "mailto:a": False, "//h/x": True, "#top": True}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", structured.is_url_text(F.col("v")).alias("ok"))
    assert {r["v"]: r["ok"] for r in df.collect()} == cases


def test_structured_findings_name_what_is_wrong(spark):
    from pagequarry.sources.html import parse_pages

    ld = lambda value: f'<script type="application/ld+json">{json.dumps(value)}</script>'
    entry = lambda position, name, item: {"@type": "ListItem", "position": position, "name": name, "item": item}
    crumbs = lambda *entries: {"@context": "https://schema.org", "@type": "BreadcrumbList", "itemListElement": list(entries)}
    html = {
        "bad": ld(crumbs(entry("x1", "A", "/a"), entry(2, "", "ht tp"), {"@type": "Thing"}, 7)),
        "twice": ld(crumbs(entry(1, "A", "/a"), entry(1, "B", "/a"), entry(3, "C", ""))),
        "hole": ld(crumbs(entry(1, "A", "/a"), entry(3, "B", "/b"))),
        "none": ld({"@context": "https://schema.org", "@type": "BreadcrumbList"}) + ld(crumbs()),
        "item": ld([{"@context": "https://schema.org", "@type": ["NewsArticle", "Article"], "url": "ftp://x"}, {"@context": "https://schema.org", "@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "q"}, 3]}]),
        "fine": ld({"@context": "https://schema.org", "@type": "WebSite", "url": "https://s.test/"}),
    }
    pages = parse_pages(spark.createDataFrame([(f"https://s.test/{k}", v) for k, v in html.items()], "url string, html string"), [])
    found = {(r["id"].removeprefix("SEO-"), r["url"].rpartition("/")[2]): r["evidence"] for r in structured.structured_findings(pages).collect()}
    lead = "json-ld block 1 (root): "
    assert found == {
        ("BREADCRUMB-001", "bad"): [lead + "element 3 is no ListItem", lead + "element 4 is no object"],
        ("BREADCRUMB-002", "bad"): [lead + 'entry 1: position "x1" is no whole number from 1', lead + "entry 2: no name", lead + 'entry 2: target "ht tp" is no URL'],
        ("BREADCRUMB-003", "twice"): [lead + "position 1 in entries 1 and 2", lead + "target /a in entries 1 and 2"],
        ("BREADCRUMB-002", "hole"): [lead + "positions leave out 2"],
        ("BREADCRUMB-001", "none"): [lead + "no itemListElement", "json-ld block 2 (root): itemListElement is empty"],
        ("SCHEMA-004", "item"): ["block 1 [0] (NewsArticle): missing headline", "block 1 [1] mainEntity[0]: no text of acceptedAnswer", "block 1 [1] mainEntity[1]: no Question"],
        ("SCHEMA-005", "item"): ["block 1 [0] (NewsArticle): missing author", "block 1 [0] (NewsArticle): missing datePublished", "block 1 [0] (NewsArticle): missing image"],
        ("SCHEMA-006", "item"): ["block 1 [0].url: ftp://x"],
        ("SCHEMA-006", "bad"): ["block 1 itemListElement[1].item: ht tp"],
        ("SCHEMA-006", "twice"): ["block 1 itemListElement[2].item: "],
    }


def test_decomposed_text_gives_the_same_tokens(spark):
    import unicodedata

    from pagequarry.functions.text import tokens

    texts = ["café zażółć gęślą", "Ｗide ÅNGSTRÖM Å", "한국어 text", "plain ascii words", None]
    rows = [(i, t and unicodedata.normalize(form, t)) for i, t in enumerate(texts) for form in ("NFC", "NFD")]
    out = spark.createDataFrame(rows, "i int, t string").select("i", tokens(F.col("t")).alias("w")).collect()
    by = {}
    for r in out:
        by.setdefault(r["i"], []).append(r["w"])
    assert all(a == b for a, b in by.values()) and by[0][0] == ["café", "zażółć", "gęślą"] and by[4][0] == []


def test_the_sample_site_has_exactly_the_expected_findings(spark):
    from collections import Counter

    from pagequarry import sample_site

    done = audit(sample_site.corpus(spark), sample_site.START, ["clean"], sample_site.robots_files(spark), sample_site.sitemap_files(spark), sample_site.other_fetches(spark))
    have = Counter((r["id"], r["url"]) for r in done.findings.where("id <> 'SEO-TERMS-002'").collect())
    assert have == Counter(sample_site.expected())
    assert len({i for i, _ in have}) > 80
    report = build_report(done, sample_site.START, "max-pages", {"max-pages": 3, "max-depth": 1})
    page_ = render(report, "html")
    assert page_.index("<section id='critical'>") < page_.index("<section id='high'>") < page_.index("<section id='info'>")
    assert page_.index("max-depth</td><td>1") < page_.index("max-pages</td><td>3") and "Crawl stopped: max-pages; 1 max-depth; 3 max-pages" in render(report)
    worst = {r["grp"]: r["severity_name"] for r in findings.worst_by_group(done.findings).collect()}
    assert worst["metadata"] == "critical" and worst["crawlability"] == "high" and worst["content"] == "medium"
    milder = findings.with_severity(done.findings, {"SEO-INDEX-006": "info"})
    assert milder.where("severity_name = 'critical'").count() == 0 and findings.at_least(milder, "high").where("severity < 3").count() == 0


def test_followed_links_and_methods(spark):
    from pagequarry.sources.html import parse_pages

    html = "<a href=/a>a</a><a href=/a>again</a><a href=https://o.test/>out</a><img src=/i.png><img src=https://o.test/j.png><a href='mailto:x'>m</a>"
    pages = parse_pages(spark.createDataFrame([("https://s.test/", html)], "url string, html string"), [], fields=("links", "images"))
    rows = crawl.followed_links(pages).select("target", crawl.request_method(F.col("target")).alias("m")).collect()
    assert {(r["target"], r["m"]) for r in rows} == {("https://s.test/a", "GET"), ("https://s.test/i.png", "HEAD")} and len(rows) == 2


def test_external_links_and_http_upgrade(spark):
    from pagequarry.operators import links

    x = "array<struct<url:string,external:boolean>>"
    pages = spark.createDataFrame([("https://s.test/", 0, [(f"https://o{k:03}.test/", True) for k in range(99, -1, -1)]), ("https://s.test/z", 1, [("https://late.test/", True), ("https://s.test/in", False)])], f"url string, depth int, links {x}")
    log = spark.createDataFrame([("https://o007.test/", 500, ""), ("https://o008.test/", 0, "timeout"), ("https://late.test/", 404, ""), ("https://o009.test/", 200, "")], "url string, status int, error string")
    assert {r["url"] for r in links.external_findings(pages, log).collect()} == {"https://o007.test/", "https://o008.test/"}
    probe = lambda *rows: [tuple(r["evidence"]) for r in checks.upgrade_findings("https://s.test/", spark.createDataFrame(list(rows), "url string, status int, error string, redirects int, final_url string")).collect()]
    assert probe(("http://s.test/", 200, "", 1, "https://s.test/")) == []
    assert probe(("http://s.test/", 200, "", 0, "http://s.test/")) == [("http://s.test/",)]
    assert probe(("http://s.test/", 0, "timeout", 0, "")) == probe() == [("no answer over http",)]


@pytest.mark.parametrize(
    ("raw", "headers", "want"),
    [
        ("<title>żółć</title>".encode(), None, "żółć"),
        ("<title>żółć</title>".encode("iso8859-2"), {"Content-Type": "text/html; charset=ISO-8859-2"}, "żółć"),
        (b"<meta charset=windows-1250>" + "<title>żółć</title>".encode("cp1250"), None, "żółć"),
        ("<title>“x” é</title>".encode("cp1252"), {"content-type": "text/html; charset=latin1"}, "“x” é"),
        ("<title>é</title>".encode("latin-1"), None, "é"),
        ("<title>é</title>".encode("utf-16"), {"content-type": "text/html; charset=utf-8"}, "é"),
        (b"<meta http-equiv=content-type content='text/html; charset=utf-16'><title>\xc3\xa9</title>", {"content-type": "text/html; charset=nonsense"}, "é"),
    ],
)
def test_page_bytes_are_decoded(raw, headers, want):
    from pagequarry.sources.html import parse_page

    assert parse_page("https://s.test/", raw, None, headers)["titles"] == [want]


def test_command_line(spark, tmp_path, capsys):
    from pagequarry import __main__ as cli
    from pagequarry import sample_site

    assert cli.start_address(" site.test/x ") == "https://site.test/x"
    few = sample_site.corpus(spark).where("url in ('https://site.test/', 'https://site.test/map', 'https://site.test/clean', 'https://site.test/gone')")
    few.coalesce(1).write.parquet(str(tmp_path / "corpus"))
    run = lambda *args: (cli.main([*args]), capsys.readouterr())
    corpus, report = str(tmp_path / "corpus"), str(tmp_path / "report.json")
    code, _ = run("audit", corpus, "site.test", "--format", "json", "--output", report, "--fail-on", "high")
    saved = json.loads((tmp_path / "report.json").read_text())
    assert code == 1 and saved["summary"]["pages"] == 3 and saved["summary"]["highest_severity"] == "critical"
    code, out = run("audit", corpus, "site.test", "--max-depth", "1", "--fail-on", "critical", "--severity", "SEO-INDEX-006=low", "--baseline", report, "--diff")
    assert code == 0 and "resolved" in out.out and "SEO-HTTP-001" in out.out
    for wrong in (["audit", corpus, "ftp://x"], ["audit", corpus, "site.test", "--max-pages", "0"], ["audit", corpus, "site.test", "--severity", "A=b"], ["audit", corpus, "site.test", "--diff"], ["nothing"]):
        assert run(*wrong)[0] == 2, wrong
    assert run("diff", report, report)[1].out == "No changes since the baseline.\n"
    assert run("version")[1].out.strip()


def test_stream_keeps_first_fetches(spark, tmp_path):
    from pagequarry.streaming.fetch_log import first_fetches, tallies

    rows = [(i % 12, datetime.datetime(2024, 1, 1, 0, i), i % 3, "fetch") for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    df.write.parquet(str(tmp_path / "in"))
    assert [tuple(r) for r in tallies(df).collect()] == [("fetch", 30, 3)]
    stream = first_fetches(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), late="1 hour")
    q = stream.writeStream.outputMode("append").format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*), count(distinct event_id) from firsts").first() == (12, 12)
