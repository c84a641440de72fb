import gzip

import pytest

from pagequarry.sources import robots, sitemap
from pagequarry.sources.dom import parse_html
from pagequarry.sources.html import header_robots, link_header_targets, parse_page
from pagequarry.sources.structured import StructuredData, is_filled, is_schema_org, type_names

BASE = "https://s.test/dir/page"


def test_implied_structure():
    page = parse_page(BASE, "<title> A &amp;\n B </title><p>one<p>two<ul><li>x<li>y</ul><b>bold")
    assert page["titles"] == ["A & B"] and page["main_text"] == "one two x y bold"


def test_head_and_body_placement():
    page = parse_page(BASE, "<head><title>T</title><link rel=canonical href='/c'></head><body><link rel='CANONICAL' href=''><title>late</title>")
    assert [(c["url"], c["in_head"], c["error"], c["relative"]) for c in page["canonicals"]] == [("https://s.test/c", True, None, True), ("", False, "empty href", False)]
    assert page["titles"] == ["T"]


def test_links_images_and_base():
    page = parse_page(BASE, "<base href='/b/'><a href='x' rel='UGC nofollow'>t</a><a href=''>none</a><a href='https://o.test/y.pdf'><img src=i.png alt=' pic '></a><h2><a href='/hidden'>in heading</a></h2><template><a href='/t'>t</a></template><svg><a href='/s'>s</a></svg>")
    assert [(x["url"], x["nofollow"], x["external"], x["resource"], x["anchor"]) for x in page["links"]] == [("https://s.test/b/x", True, False, False, "t"), ("https://o.test/y.pdf", False, True, True, "pic")]
    assert page["images"][0]["src"] == "https://s.test/b/i.png" and page["images"][0]["has_alt"]
    assert page["headings"] == [{"level": 2, "text": "in heading"}]


def test_main_text_skips_chrome_and_hidden():
    html = "<body><nav>n</nav><main>keep<aside>no</aside><p hidden>no</p><p aria-hidden=true>no</p><script>no</script></main><footer>f</footer>"
    assert parse_page(BASE, html)["main_text"] == "keep"
    assert parse_page(BASE, "<nav><article>no</article></nav>yes")["main_text"] == "yes"


def test_headers():
    page = parse_page(BASE, "", None, {"Link": '<https://s.test/h>; rel="canonical", <x>; rel=next', "X-Robots-Tag": "googlebot: noindex, nofollow"})
    assert page["canonicals"][0]["url"] == "https://s.test/h" and page["robots"] == [{"source": "header", "agent": "googlebot", "value": "noindex, nofollow"}]
    assert header_robots("max-snippet: 5") == ("robots", "max-snippet: 5") and link_header_targets("<a,b>; rel=canonical") == ["a,b"]


@pytest.mark.parametrize("html", ["", "<", "</", "<!--", "<![CDATA[", "<a <b>", "<p></div></p></p>", "<table><tr><td><table></td>", "\x00￾", "<html lang>" * 50, "<svg><p></svg>", "<title>" * 9])
def test_parser_never_fails(html):
    assert parse_html(html).children and parse_page(BASE, html)["main_text"] is not None


def test_mixed_content_only_on_https():
    html = "<img src=' HTTP://x/a'><script src=http://x/b></script>"
    assert len(parse_page(BASE, html)["mixed"]) == 2 and parse_page("http://s.test/", html)["mixed"] == []


def test_json_ld():
    data = StructuredData()
    for block in ('{"@context":"https://schema.org/","@graph":[{"@type":"Organization"},{"@id":"#x"},{"name":"untyped"}]}', "{bad", "", '"text"', '{"@type":"schema:Article","headline":"h","author":{"@type":"Person"}}', '[{"@context":"http://schema.org","@type":"FAQPage","mainEntity":{"@type":"Question","name":"q"}}]', '{"@context":"https://schema.org","@type":"Product","name":"p","offers":{},"url":"ht tp"}'):
        data.add_block(block)
    assert [e.split(":")[0] for e in data.errors] == ["block 2", "block 3", "block 4"]
    assert len(data.untyped) == 1 and len(data.context) == 1
    facts = {i["types"][0]: i for i in data.item_facts()}
    assert facts["Organization"]["filled"] == ["@type"] and facts["Organization"]["top"] and not facts["Person"]["top"]
    assert facts["FAQPage"]["faq"] == [{"question": True, "named": True, "answered": False}]
    assert facts["Product"]["filled"] == ["@context", "@type", "name", "url"] and facts["Product"]["links"] == [{"property": "url", "text": "ht tp"}]


def test_schema_helpers():
    assert type_names(["https://schema.org/A", "schema:B", "A", 3]) == ["A", "B"]
    assert is_schema_org([{"@vocab": "http://schema.org"}]) and not is_schema_org("https://example.com")
    assert [is_filled(x) for x in (None, " ", "x", [], [" ", {"a": 1}], {}, False)] == [False, False, True, False, True, False, True]


def test_breadcrumb_facts_of_both_kinds():
    html = """<ol itemscope itemtype="https://schema.org/BreadcrumbList"><li itemprop="itemListElement" itemscope itemtype="https://schema.org/ListItem">
    <a itemprop="item" href="/a"><span itemprop="name">A</span></a><meta itemprop="position" content="1"></li>
    <li itemprop="itemListElement" itemscope itemtype="https://schema.org/ListItem"><span itemprop="name">B</span><meta itemprop="position" content="3"></li></ol>
    <script type="application/ld+json">{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"","item":{"@id":"/x","name":"N"}},{"@type":"Thing"},4]}</script>"""
    ld, micro = parse_page(BASE, html)["crumbs"]
    entry = lambda kind, position="", name="", item="": {"kind": kind, "position": position, "name": name, "item": item}
    assert ld == {"source": "json-ld", "place": "block 1 (root)", "given": "list", "entries": [entry("entry", "1", "N", "/x"), entry("object"), entry("other")]}
    assert micro == {"source": "microdata", "place": "item 1", "given": "list", "entries": [entry("entry", "1", "A", "https://s.test/a"), entry("entry", "3", "B")]}


def test_robots_file():
    out = robots.parse_robots(b"\xef\xbb\xbfDisallow: /x\nUser-agent: A/1\nUser-Agent: *\nDisallow: /p%7e # c\nDisallow:\nAllow: /\xc5\xbc\nCrawl-delay: 2\nSitemap: https://s/x\nnonsense\nfoo: bar\r\nUser-agent: b\nDisallow: /")
    assert [(r["grp"], r["allow"], r["pattern"]) for r in out["rules"]] == [(0, False, "/p~"), (0, True, "/%C5%BC"), (1, False, "/")]
    assert out["rules"][0]["agents"] == ["a/1", "*"] and [w["line"] for w in out["warnings"]] == [1, 9, 10]
    assert out["delays"][0]["seconds"] == 2.0 and out["sitemaps"] == [{"url": "https://s/x", "line": 8}]
    assert robots.parse_robots(b"a" * (600 << 10))["truncated"]


def test_sitemaps():
    xml = b'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://s/a </loc><lastmod>2024-02-30</lastmod></url><url><priority>1</priority></url><other><loc>x</loc></other></urlset>'
    for body in (xml, gzip.compress(xml)):
        out = sitemap.parse_sitemap(body)
        assert out["kind"] == "urlset" and [e["loc"] for e in out["entries"]] == ["https://s/a"] and len(out["warnings"]) == 2
    assert sitemap.is_packed(b"x", "https://s/m.XML.gz") and not sitemap.is_packed(b" <urlset", "https://s/m.xml.gz") and sitemap.is_packed(b"<", "", "application/x-gzip; q=1") and not sitemap.is_packed(b"", "https://s/m.gz")
    assert sitemap.parse_sitemap(b"no gzip", "https://s/m.gz")["error"].startswith("gzip") and sitemap.parse_sitemap(xml, "https://s/m.gz")["kind"] == "urlset"
    assert sitemap.parse_sitemap(b"<html/>")["invalid"] and sitemap.parse_sitemap(b"<urlset><url>")["invalid"] and sitemap.parse_sitemap(b"\x1f\x8bbad")["error"]
    assert [sitemap.is_lastmod(x) for x in ("2024", "2024-13", "2024-01-31", "2024-01-31T10:00Z", "2024-01-31T10:00:00.123456789+01:00", "31.1.2024")] == [True, False, True, True, True, False]


def test_parsed_files_as_frames(spark):
    files = spark.createDataFrame([("https://s/robots.txt", "User-agent: *\nDisallow: /x")], "url string, body string")
    assert robots.parse_robots_files(files, ["url"]).first()["rules"][0]["pattern"] == "/x"
    maps = spark.createDataFrame([("https://s/m.xml", '<urlset xmlns="n"><url><loc>https://s/</loc></url></urlset>')], "url string, body string")
    r = sitemap.parse_sitemap_files(maps, ["url"]).first()
    assert r["entries"][0]["loc"] == "https://s/" and len(r["warnings"]) == 1
