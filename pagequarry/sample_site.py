"""A small stored site in which each rule that an audit emits shows on a page made for it.

``PAGES`` lists the pages with the findings expected of them, written down by hand next to what provokes them; every
page starts out clean, so what is not listed must not be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORIGIN = "https://site.test"
START = ORIGIN + "/"
CORPUS = "url string, depth int, status int, error string, redirects int, final_url string, content_type string, headers map<string,string>, html string"
SAFE = {"Strict-Transport-Security": "max-age=600", "X-Content-Type-Options": "nosniff", "Referrer-Policy": "no-referrer", "Content-Security-Policy": "default-src 'self'; frame-ancestors 'none'"}


def words(seed: str, n: int = 60) -> str:
    """Text that no other page has: ``n`` words made of the page's name."""
    seed = seed.replace("-", "")
    return " ".join(f"{seed}{chr(97 + k // 26)}{chr(97 + k % 26)}word" for k in range(n))


def crumb(position, name, item) -> str:
    target = f',"item":"{item}"' if item else ""
    return f'{{"@type":"ListItem","position":{position},"name":"{name}"{target}}}'


def ld(body: str) -> str:
    return f'<script type="application/ld+json">{body}</script>'


CONTEXT = '"@context":"https://schema.org"'


def page(name: str, *, title=None, desc=None, canonical=None, head="", body="", h1=None, text=None, lang="en", expect=(), headers=None, **fetch) -> dict:
    """A clean page but for what is given; ``title``, ``desc``, ``canonical`` and ``h1`` replace whole elements."""
    path = "/" if name == "start" else f"/{name}"
    title = f"<title>The {name} page of a sample site</title>" if title is None else title
    desc = f'<meta name="description" content="What the {name} page is about, in a text of a sensible length for search.">' if desc is None else desc
    canonical = f'<link rel="canonical" href="{ORIGIN}{path}">' if canonical is None else canonical
    h1 = f"<h1>Heading of {name}</h1>" if h1 is None else h1
    text = words(name) if text is None else text
    attribute = f' lang="{lang}"' if lang is not None else ""
    html = f"<!doctype html><html{attribute}><head>{title}{desc}{canonical}{head}</head><body><main>{h1}<p>{text}</p>{body}</main></body></html>"
    own = {"status": 200, "error": "", "redirects": 0, "final_url": ORIGIN + path, "content_type": "text/html; charset=utf-8", "html": html, "depth": 0 if name == "start" else 1}
    return {"path": path, "headers": SAFE if headers is None else headers, "expect": list(expect), **own, **fetch}


def without(name: str) -> dict:
    return {k: v for k, v in SAFE.items() if k != name}


_SAME = words("twin")
PAGES = [
    page("clean"),
    # metadata
    page("no-title", title="", expect=["SEO-TITLE-001"]),
    page("empty-title", title="<title> </title>", expect=["SEO-TITLE-002"]),
    page("two-titles", title="<title>The first of two titles of a page</title><title>The second of two titles</title>", expect=["SEO-TITLE-003"]),
    page("short-title", title="<title>Short one</title>", expect=["SEO-TITLE-005"]),
    page("long-title", title=f"<title>A title that {'goes on and ' * 6}on</title>", expect=["SEO-TITLE-006"]),
    page("title-one", title="<title>One title that two pages share</title>", expect=["SEO-TITLE-004"]),
    page("title-two", title="<title>One title that two pages share</title>", expect=["SEO-TITLE-004"]),
    page("no-desc", desc="", expect=["SEO-DESC-001"]),
    page("empty-desc", desc='<meta name="description" content="">', expect=["SEO-DESC-002"]),
    page("two-descs", desc='<meta name="description" content="A first description that is as long as it should be, surely."><meta name="description" content="x">', expect=["SEO-DESC-003"]),
    page("desc-one", desc='<meta name="description" content="One description that two different pages share, word by word.">', expect=["SEO-DESC-004"]),
    page("desc-two", desc='<meta name="description" content="One description that two different pages share, word by word.">', expect=["SEO-DESC-004"]),
    page("short-desc", desc='<meta name="description" content="Too short.">', expect=["SEO-DESC-005"]),
    # headings
    page("no-h1", h1="", expect=["SEO-HEADING-001"]),
    page("two-h1", body="<h1>Another main heading</h1>", expect=["SEO-HEADING-002"]),
    page("empty-heading", body="<h2></h2>", expect=["SEO-HEADING-003"]),
    page("heading-skip", body="<h4>Deep</h4>", expect=["SEO-HEADING-004"]),
    page("h1-one", h1="<h1>Shared Heading</h1>", expect=["SEO-HEADING-005"]),
    page("h1-two", h1="<h1>shared heading</h1>", expect=["SEO-HEADING-005"]),
    # canonicals
    page("no-canonical", canonical="", expect=["SEO-CANONICAL-001"]),
    page("two-canonicals", canonical=f'<link rel="canonical" href="{ORIGIN}/two-canonicals"><link rel="canonical" href="{ORIGIN}/clean">', expect=["SEO-CANONICAL-002"]),
    page("relative-canonical", canonical='<link rel="canonical" href="/relative-canonical">', expect=["SEO-CANONICAL-003"]),
    page("bad-canonical", canonical='<link rel="canonical" href="ftp://site.test/">', expect=["SEO-CANONICAL-004"]),
    page("body-canonical", canonical="", body=f'<link rel="canonical" href="{ORIGIN}/body-canonical">', expect=["SEO-CANONICAL-005"]),
    page("foreign-canonical", canonical='<link rel="canonical" href="https://other.test/">', expect=["SEO-CANONICAL-006"]),
    page("lost-canonical", canonical=f'<link rel="canonical" href="{ORIGIN}/gone">', expect=["SEO-CANONICAL-007"]),
    page("moved-canonical", canonical=f'<link rel="canonical" href="{ORIGIN}/old">', expect=["SEO-CANONICAL-008"]),
    page("loop-a", canonical=f'<link rel="canonical" href="{ORIGIN}/loop-b">', expect=["SEO-CANONICAL-009"]),
    page("loop-b", canonical=f'<link rel="canonical" href="{ORIGIN}/loop-a">', expect=["SEO-CANONICAL-009"]),
    page("chain-a", canonical=f'<link rel="canonical" href="{ORIGIN}/chain-b">', expect=["SEO-CANONICAL-010"]),
    page("chain-b", canonical=f'<link rel="canonical" href="{ORIGIN}/clean">'),
    # robots directives
    page("noindex", head='<meta name="robots" content="noindex">', expect=["SEO-INDEX-001"]),
    page("nofollow", head='<meta name="robots" content="nofollow">', expect=["SEO-INDEX-002"]),
    page("contradiction", head='<meta name="robots" content="noindex"><meta name="robots" content="index">', expect=["SEO-INDEX-001", "SEO-INDEX-003"]),
    page("odd-directive", head='<meta name="robots" content="sometimes">', expect=["SEO-INDEX-004"]),
    page("no-snippet", head='<meta name="robots" content="nosnippet">', expect=["SEO-INDEX-005"]),
    page("hidden-copy", head='<meta name="robots" content="noindex">', canonical=f'<link rel="canonical" href="{ORIGIN}/clean">', expect=["SEO-INDEX-001", "SEO-INDEX-007"]),
    # languages
    page("no-lang", lang=None, expect=["SEO-LANG-001"]),
    page("bad-lang", lang="e_n", expect=["SEO-LANG-002"]),
    page("other-lang", head=f'<link rel="alternate" hreflang="de" href="{ORIGIN}/other-lang">', expect=["SEO-LANG-003"]),
    page("hreflang-twice", head=f'<link rel="alternate" hreflang="en" href="{ORIGIN}/hreflang-twice"><link rel="alternate" hreflang="en" href="{ORIGIN}/nowhere">', expect=["SEO-HREFLANG-002"]),
    page("hreflang-bad", head=f'<link rel="alternate" hreflang="en-UK" href="{ORIGIN}/hreflang-bad">', expect=["SEO-HREFLANG-003"]),
    page("hreflang-absent", head=f'<link rel="alternate" hreflang="en" href="{ORIGIN}/nowhere">', expect=["SEO-HREFLANG-004"]),
    page("hreflang-two", head=f'<link rel="alternate" hreflang="en" href="{ORIGIN}/hreflang-two"><link rel="alternate" hreflang="fr" href="{ORIGIN}/nowhere">', expect=["SEO-HREFLANG-005"]),
    page("hreflang-hidden", head=f'<link rel="alternate" hreflang="en" href="{ORIGIN}/hreflang-hidden"><link rel="alternate" hreflang="x-default" href="{ORIGIN}/noindex">', expect=["SEO-HREFLANG-006", "SEO-HREFLANG-007"]),
    page("hreflang-lost", head=f'<link rel="alternate" hreflang="en" href="{ORIGIN}/hreflang-lost"><link rel="alternate" hreflang="x-default" href="{ORIGIN}/gone">', expect=["SEO-HREFLANG-006"]),
    # social, images, links
    page("social-differ", head='<meta property="og:title" content="A"><meta property="og:type" content="article"><meta property="og:url" content="https://site.test/social-differ"><meta property="og:image" content="https://site.test/i.png"><meta name="twitter:card" content="summary"><meta name="twitter:title" content="B">', expect=["SEO-SOCIAL-002"]),
    page("social-image", head='<meta property="og:title" content="A"><meta property="og:type" content="article"><meta property="og:url" content="https://site.test/social-image"><meta property="og:image" content="/i.png">', expect=["SEO-SOCIAL-004"]),
    page("social-part", head='<meta property="og:title" content="A">', expect=["SEO-SOCIAL-005"]),
    page("image-alt", body='<img src="/pic.png" width="1" height="1">', expect=["SEO-IMAGE-001"]),
    page("image-size", body='<img src="/pic.png" alt="a">', expect=["SEO-IMAGE-002"]),
    page("image-mode", body='<img src="/pic.png" alt="a" width="1" height="1" loading="soon">', expect=["SEO-IMAGE-003"]),
    page("image-lost", body='<img src="/lost.png" alt="a" width="1" height="1">', expect=["SEO-LINK-004"]),
    page("bare-link", body='<a href="/clean"></a>', expect=["SEO-ANCHOR-001"]),
    page("two-targets", body='<a href="/title-one">same words</a><a href="/title-two">same words</a>', expect=["SEO-ANCHOR-002"]),
    page("self-link", body='<a href="/self-link">me</a>', expect=["SEO-LINK-002"]),
    page("orphan", expect=["SEO-LINK-001"]),
    page("outside", body='<a href="https://dead.test/">dead</a><a href="https://fine.test/">fine</a>'),
    page("plain-resource", body='<img src="http://cdn.test/x.png" alt="a" width="1" height="1">', expect=["WEB-HYGIENE-005"]),
    # content
    page("thin", text="Only a few words on this page.", expect=["SEO-CONTENT-002"]),
    page("no-text", h1="", text="", expect=["SEO-CONTENT-003", "SEO-HEADING-001"]),
    page("mostly-script", text=words("mostlyscript", 45), body=f"<script>{'var x = 1; ' * 2500}</script>", expect=["SEO-CONTENT-001"]),
    page("twin-a", h1="<h2>Twin</h2>", text=_SAME, expect=["SEO-DUPLICATE-001", "SEO-HEADING-001", "SEO-HEADING-004"]),
    page("twin-b", h1="<h2>Twin</h2>", text=_SAME, expect=["SEO-TERMS-003", "SEO-HEADING-001", "SEO-HEADING-004"]),
    page("near-a", h1="<h2>Near</h2>", text=words("near", 300), expect=["SEO-DUPLICATE-002", "SEO-HEADING-001", "SEO-HEADING-004"]),
    page("near-b", h1="<h2>Near</h2>", text=words("near", 300) + " indeed", expect=["SEO-HEADING-001", "SEO-HEADING-004"]),
    # structured data
    page("broken-ld", head=ld("{"), expect=["SEO-SCHEMA-001"]),
    page("untyped-ld", head=ld(f'{{{CONTEXT},"name":"x","url":"/"}}'), expect=["SEO-SCHEMA-002"]),
    page("no-context", head=ld('{"@type":"WebSite","name":"x","url":"/"}'), expect=["SEO-SCHEMA-003"]),
    page("lacking-ld", head=ld(f'{{{CONTEXT},"@type":"Organization","url":"/","logo":"/l.png"}}'), expect=["SEO-SCHEMA-004"]),
    page("better-ld", head=ld(f'{{{CONTEXT},"@type":"WebSite","name":"x"}}'), expect=["SEO-SCHEMA-005"]),
    page("bad-url-ld", head=ld(f'{{{CONTEXT},"@type":"WebSite","url":"ht tp"}}'), expect=["SEO-SCHEMA-006"]),
    page("many-ld", head=ld(f'{{{CONTEXT},"@type":"Thing"}}') * 51, expect=["SEO-SCHEMA-007"]),
    page("crumbs-none", head=ld(f'{{{CONTEXT},"@type":"BreadcrumbList"}}'), expect=["SEO-BREADCRUMB-001"]),
    page("crumbs-gap", head=ld(f'{{{CONTEXT},"@type":"BreadcrumbList","itemListElement":[{crumb(1, "A", "/")},{crumb(3, "B", "")}]}}'), expect=["SEO-BREADCRUMB-002"]),
    page("crumbs-twice", head=ld(f'{{{CONTEXT},"@type":"BreadcrumbList","itemListElement":[{crumb(1, "A", "/")},{crumb(1, "B", "/b")}]}}'), expect=["SEO-BREADCRUMB-003"]),
    # headers
    page("may-sniff", headers=without("X-Content-Type-Options"), expect=["WEB-HYGIENE-002"]),
    page("refers", headers=without("Referrer-Policy"), expect=["WEB-HYGIENE-003"]),
    page("no-hsts", headers=without("Strict-Transport-Security"), expect=["WEB-HYGIENE-006"]),
    page("no-csp", headers={**without("Content-Security-Policy"), "X-Frame-Options": "DENY"}, expect=["WEB-HYGIENE-007"]),
    page("framed", headers={**SAFE, "Content-Security-Policy": "default-src 'self'"}, expect=["WEB-HYGIENE-008"]),
    page("plain", final_url="http://site.test/plain", redirects=1, canonical='<link rel="canonical" href="http://site.test/plain">', expect=["SEO-HTTP-002"]),
    # fetches that lead nowhere
    page("gone", status=404, expect=["SEO-HTTP-001"]),
    page("dead", status=0, error="timeout", final_url="", html=None, headers={}, expect=["SEO-HTTP-001"]),
    page("old", redirects=1, final_url=ORIGIN + "/new", canonical=f'<link rel="canonical" href="{ORIGIN}/new">', expect=["SEO-HTTP-002"]),
    page("unread", html=None, expect=["SEO-HTTP-003"]),
    page("lost.png", status=404, html=None, content_type="image/png", expect=["SEO-HTTP-001"]),
]
_LINKED = [p["path"] for p in PAGES if p["path"] not in ("/orphan", "/lost.png", "/clean")]
#: The map links to all pages under the name of each; the start page, which must not be indexed, leads to the map only.
PAGES.append(page("map", body='<a href="/clean">clean</a><a href="http://site.test/plain">plain form</a><a href="/new">new</a>' + "".join(f'<a href="{p}">{p[1:]}</a>' for p in _LINKED)))
PAGES.insert(0, page("start", head='<meta name="robots" content="noindex">', body='<a href="/map">all pages</a>', expect=["SEO-INDEX-006"]))
PAGES[1] = page("clean", body='<a href="/map">map</a>')

ROBOTS_TXT = "User-agent: *\nDisallow: /orphan\nSitemap: https://site.test/sitemap.xml\nSitemap: relative.xml\nnonsense"
_LISTED = ["/clean", "/gone", "/old", "/noindex", "/loop-a", "/orphan", "/thin"]
SITEMAP = "<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<url><loc>{ORIGIN}{p}</loc></url>" for p in _LISTED) + "<url><loc>https://other.test/</loc></url><url><loc>no address</loc></url><url><lastmod>2024</lastmod></url></urlset>"
#: Expected of the site and of addresses that are no pages: (rule, url).
SITE_EXPECT = [
    ("SEO-ROBOTS-005", "/robots.txt"),
    ("SEO-ROBOTS-007", "/robots.txt"),
    ("SEO-SITEMAP-005", "/sitemap.xml"),
    ("SEO-SITEMAP-006", ""),
    ("SEO-SITEMAP-007", ""),
    *(("SEO-SITEMAP-010", p) for p in ("/gone", "/old", "/noindex", "/loop-a", "/orphan")),
    ("SEO-LINK-003", ""),
    ("SEO-TERMS-001", ""),
    *(("SEO-LINK-004", "") for _ in ("gone", "dead")),
    ("SEO-LINK-008", "https://dead.test/"),
    ("WEB-HYGIENE-004", "/"),
    ("WEB-HYGIENE-001", "http://site.test/plain"),
]


def corpus(spark: SparkSession) -> DataFrame:
    names = [c.split()[0] for c in CORPUS.split(", ")]
    return spark.createDataFrame([tuple({**p, "url": ORIGIN + p["path"]}[n] for n in names) for p in PAGES], CORPUS)


def robots_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{ORIGIN}/robots.txt", f"{ORIGIN}/robots.txt", 200, "", ROBOTS_TXT)], "url string, final_url string, status int, error string, body string")


def sitemap_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{ORIGIN}/sitemap.xml", 200, "", SITEMAP)], "url string, status int, error string, body string")


def other_fetches(spark: SparkSession) -> DataFrame:
    rows = [("https://dead.test/", 0, "timeout", 0, ""), ("https://fine.test/", 200, "", 0, "https://fine.test/"), ("http://site.test/", 200, "", 0, "http://site.test/")]
    return spark.createDataFrame(rows, "url string, status int, error string, redirects int, final_url string")


def expected() -> list[tuple[str, str]]:
    """(rule, url) of every finding, but for terms of single pages (every indexable page with text has some)."""
    full = lambda u: u if u == "" or "://" in u else ORIGIN + u
    out = []
    for p in PAGES:  # fetches are known by what was asked for, pages by where that led
        out += [(rule, ORIGIN + p["path"] if rule.startswith("SEO-HTTP") else p["final_url"]) for rule in p["expect"]]
    return out + [(rule, full(u)) for rule, u in SITE_EXPECT]
