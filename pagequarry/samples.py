"""Small tables that exercise what the parquet tables lack, shared by queries and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "fetched": (
        "url string, status int, error string, redirects int, final_url string, canonical string",
        [
            ("https://s.test/a", 200, "", 0, "https://s.test/a", "https://s.test/b"),
            ("https://s.test/b", 200, "", 0, "https://s.test/b", "https://s.test/c"),
            ("https://s.test/c", 200, "", 0, "https://s.test/c", "https://s.test/c"),
            ("https://s.test/l1", 200, "", 0, "https://s.test/l1", "https://s.test/l2"),
            ("https://s.test/l2", 200, "", 0, "https://s.test/l2", "https://s.test/l3"),
            ("https://s.test/l3", 200, "", 0, "https://s.test/l3", "https://s.test/l1"),
            ("https://s.test/gone", 404, "", 0, "https://s.test/gone", ""),
            ("https://s.test/moved", 200, "", 1, "https://s.test/c", ""),
            ("https://s.test/dead", 0, "timeout", 0, "", ""),
            ("https://s.test/p1", 200, "", 0, "https://s.test/p1", "https://s.test/gone"),
            ("https://s.test/p2", 200, "", 0, "https://s.test/p2", "https://s.test/moved"),
            ("https://s.test/p3", 200, "", 0, "https://s.test/p3", "https://s.test/dead"),
            ("https://s.test/p4", 200, "", 0, "https://s.test/p4", "https://s.test/unknown"),
            ("https://s.test/p5", 200, "", 0, "https://s.test/p5", "https://s.test/a"),
        ],
    ),
    "alternates": (
        "url string, pos int, href string, target string",
        [
            ("https://s.test/en", 1, "https://s.test/en", "en"),
            ("https://s.test/en", 2, "https://s.test/de", "de"),
            ("https://s.test/en", 3, "https://s.test/x", "x-default"),
            ("https://s.test/de", 1, "https://s.test/de", "de"),
            ("https://s.test/de", 2, "https://s.test/de2", "DE"),
            ("https://s.test/fr", 1, "https://s.test/en", "en-UK"),
            ("https://s.test/fr", 2, "https://s.test/de", "de-AT"),
            ("https://s.test/fr", 3, "https://s.test/en", "zz"),
            ("https://s.test/fr", 4, "https://s.test/de", "zh-Hant-TW"),
            ("https://s.test/fr", 5, "https://s.test/de", "pt_BR"),
        ],
    ),
    "robots_rules": (
        "origin string, agent string, allow boolean, pattern string, line int",
        [
            ("o1", "*", False, "/private", 2),
            ("o1", "*", True, "/private/open", 3),
            ("o1", "*", False, "/*.pdf$", 4),
            ("o1", "*", False, "/q?", 5),
            ("o1", "googlebot", False, "/no-google", 8),
            ("o1", "googlebot", True, "/no-google", 9),
            ("o1", "bingbot/2.0", False, "/", 12),
            ("o1", "bingbot/2.0", True, "/$", 13),
            ("o2", "*", False, "/", 1),
            ("o2", "emptybot", None, None, None),
        ],
    ),
    "robots_asked": (
        "origin string, asked string, path string",
        [(o, a, p) for o in ("o1", "o2") for a in ("*", "googlebot", "bingbot", "emptybot") for p in ("/", "/private/x", "/private/open/x", "/a.pdf", "/a.pdf?x", "/q?x=1", "/no-google", "/robots.txt")],
    ),
    "robots_meta": (
        "url string, source string, agent string, value string",
        [
            ("https://s.test/1", "meta", "robots", "noindex, follow"),
            ("https://s.test/1", "header", "robots", "index"),
            ("https://s.test/2", "meta", "googlebot", "none"),
            ("https://s.test/3", "meta", "bingbot", "noindex"),
            ("https://s.test/4", "meta", "robots", "max-snippet:50, max-snippet:0, max-image-preview:large, max-image-preview:none"),
            ("https://s.test/5", "meta", "robots", "max-snippet:-1, nosnippet, NoArchive, wrong, max-snippet:x, unavailable_after:"),
            ("https://s.test/6", "meta", "robots", "all, max-video-preview:10, unavailable_after: 2030-01-01"),
        ],
    ),
    "social": (
        "url string, pos int, property string, value string",
        [
            ("https://s.test/1", 1, "og:title", "One"),
            ("https://s.test/1", 2, "twitter:title", "ONE"),
            ("https://s.test/1", 3, "og:image", "/rel.png"),
            ("https://s.test/2", 1, "og:title", "Two"),
            ("https://s.test/2", 2, "og:title", "Last"),
            ("https://s.test/2", 3, "twitter:title", "Two"),
            ("https://s.test/2", 4, "twitter:image", "https://s.test/i.png"),
            ("https://s.test/3", 1, "og:title", "T"),
            ("https://s.test/3", 2, "og:type", "article"),
            ("https://s.test/3", 3, "og:url", "https://s.test/3"),
            ("https://s.test/3", 4, "og:image", "https://s.test/3.png"),
            ("https://s.test/4", 1, "twitter:card", "summary"),
        ],
    ),
    "images": (
        "url string, pos int, src string, has_alt boolean, width int, height int, loading string",
        [
            ("https://s.test/1", 1, "https://s.test/a.png", True, 10, 10, ""),
            ("https://s.test/1", 2, "https://s.test/b.png", False, 10, 0, "lazy"),
            ("https://s.test/2", 1, "https://s.test/c.png", False, 5, 5, "soon"),
            ("https://s.test/2", 2, "", True, 0, 0, "eager"),
        ],
    ),
    "headings": (
        "url string, pos int, level int, text string",
        [
            ("https://s.test/1", 1, 1, "A"),
            ("https://s.test/1", 2, 2, "B"),
            ("https://s.test/1", 3, 4, "C"),
            ("https://s.test/2", 1, 2, "D"),
            ("https://s.test/2", 2, 1, ""),
            ("https://s.test/3", 1, 1, "E"),
            ("https://s.test/3", 2, 1, "F"),
        ],
    ),
    "headers": (
        "url string, ord int, name string, value string",
        [
            ("https://s.test/1", 1, "Strict-Transport-Security", "max-age=1"),
            ("https://s.test/1", 1, "x-content-type-options", "NoSniff"),
            ("https://s.test/1", 1, "Referrer-Policy", "no-referrer"),
            ("https://s.test/1", 1, "Content-Security-Policy", "frame-ancestors 'none'"),
            ("https://s.test/2", 2, "Strict-Transport-Security", "soon"),
            ("https://s.test/2", 2, "X-Content-Type-Options", "maybe"),
            ("https://s.test/2", 2, "X-Frame-Options", "DENY"),
            ("http://s.test/3", 3, "Server", "x"),
        ],
    ),
    "schema_items": (
        "url string, item int, type string, top boolean, property string, value string",
        [
            ("https://s.test/1", 1, "Organization", True, "name", "N"),
            ("https://s.test/1", 2, "NewsArticle", True, "headline", ""),
            ("https://s.test/1", 3, "Product", False, "name", "P"),
            ("https://s.test/1", 3, "Product", False, "review", "R"),
            ("https://s.test/2", 1, "Store", True, "name", "S"),
            ("https://s.test/2", 1, "Store", True, "address", "A"),
            ("https://s.test/2", 1, "Store", True, "url", "https://s.test"),
            ("https://s.test/2", 2, "Unknown", True, "name", "U"),
        ],
    ),
    "crumbs": (
        "url string, list int, idx int, position int, name string, item string",
        [
            ("https://s.test/1", 1, 1, 1, "Home", "/"),
            ("https://s.test/1", 1, 2, 2, "Shop", "/shop"),
            ("https://s.test/1", 1, 3, 3, "This", ""),
            ("https://s.test/2", 1, 1, 1, "", "/"),
            ("https://s.test/2", 1, 2, 1, "Twice", "/"),
            ("https://s.test/3", 1, 1, 1, "A", ""),
            ("https://s.test/3", 1, 2, 3, "B", "/b"),
        ],
    ),
    "sitemap_listed": (
        "site string, url string, lastmod string",
        [
            ("s.test", "https://s.test/c", "2024-01-31"),
            ("s.test", "https://s.test/gone", "2024-02-30"),
            ("s.test", "https://s.test/moved", "2024"),
            ("s.test", "https://s.test/new", "2024-01-31T10:00Z"),
            ("s.test", "https://other.test/", "yesterday"),
            ("s.test", "https://www.s.test/w", "2024-13"),
            ("s.test", "https://s.test/c", ""),
        ],
    ),
    "addresses": (
        "ip string",
        [(x,) for x in ("8.8.8.8", "10.1.2.3", "127.0.0.1", "169.254.169.254", "169.254.1.1", "100.64.0.1", "192.168.1.1", "224.0.0.1", "255.255.255.255", "240.0.0.1", "0.0.0.1", "198.18.0.1", "172.31.255.255", "172.32.0.0", "1.1.1.1", "203.0.113.9")],
    ),
    "urls_in": (
        "id int, raw string, normal string",
        [
            (1, "HTTP://Example.COM:80/a/../b", "http://example.com/b"),
            (2, "http://Shop.Example.org:00080/x", "http://shop.example.org/x"),
            (3, "https://example.com/%7euser/%2e%2e/x", "https://example.com/x"),
            (4, "https://shop.example.org/50%-off", "https://shop.example.org/50%25-off"),
            (5, "https://example.com/ż?q=ł", "https://example.com/%C5%BC?q=%C5%82"),
            (6, "https://my_host.example/", "https://my_host.example/"),
            (7, "https://example.com/a#frag", "https://example.com/a"),
            (8, "https://example.com/?b=2&a=1", "https://example.com/?b=2&a=1"),
            (9, "ftp://example.com/", ""),
            (10, "https://me:secret@shop.example.org/", ""),
            (11, "//example.com/x", ""),
            (12, "https://example.com:99999/", ""),
            (13, "https://[2001:DB8::1]:8080/x", "https://[2001:db8::1]:8080/x"),
            (14, " https://example.com/a\tb ", "https://example.com/ab"),
        ],
    ),
    "errors": (
        "id int, error string, kind string",
        [(1, "", ""), (2, "network blocked: private address", "blocked"), (3, "redirect loop", "redirect-loop"), (4, "too many redirects", "too-many-redirects"), (5, "body too large", "too-large"), (6, "context deadline exceeded", "timeout"), (7, "unsupported content encoding br", "unsupported-encoding"), (8, "unsupported URL", "invalid-url"), (9, "request canceled", "canceled"), (10, "connection refused", "network")],
    ),
    "hops": (
        "url string, status int, location string, error string",
        [
            ("https://s.test/ok", 200, "", ""),
            ("https://s.test/one", 301, "https://s.test/ok", ""),
            ("https://s.test/relative", 302, "/one", ""),
            ("https://s.test/turn", 307, "/turn-back", ""),
            ("https://s.test/turn-back", 308, "/turn", ""),
            ("https://s.test/self", 303, "/self", ""),
            ("https://s.test/mute", 301, "", ""),
            ("https://s.test/not-modified", 304, "/ok", ""),
            ("https://s.test/lost", 301, "/missing", ""),
            ("https://s.test/down", 0, "", "timeout"),
            ("https://s.test/to-down", 302, "/down", ""),
            ("https://s.test/bad", 302, "ftp://s.test/", ""),
            *((f"https://s.test/step{k}", 301, f"/step{k + 1}", "") for k in range(12)),
            ("https://s.test/step12", 200, "", ""),
        ],
    ),
    "resolved": (
        "host string, ip string",
        [
            ("fine.test", "8.8.8.8"),
            ("fine.test", "1.1.1.1"),
            ("mixed.test", "8.8.8.8"),
            ("mixed.test", "10.0.0.1"),
            ("meta.test", "169.254.169.254"),
            ("localhost", "8.8.8.8"),
            ("App.LOCALHOST.", None),
            ("localhost.test", "8.8.8.8"),
            ("nothing.test", None),
        ],
    ),
    "terms": ("term string", [(t,) for t in ("seo", "a1", "ab", "x", "2024", "web design", "a bc", "pl 2", "café", "12ab", "c3po rd2")]),
}


def _as_html(blocks: list) -> str:
    return f'<html><head><script type="application/ld+json">{json.dumps(blocks)}</script></head><body></body></html>'


def _ld_pages() -> list[tuple]:
    """``schema_items`` as pages: an array of items; those below the top hang on another one."""
    pages: dict[str, dict] = {}
    for url, item, kind, top, name, value in TABLES["schema_items"][1]:
        pages.setdefault(url, {}).setdefault(item, (kind, top, {}))[2][name] = value
    lead = {"@context": "https://schema.org"}
    return [(url, _as_html([{**lead, "@type": kind, **props} if top else {**lead, "@type": "Thing", "about": {"@type": kind, **props}} for kind, top, props in items.values()])) for url, items in pages.items()]


def _crumb_pages() -> list[tuple]:
    """``crumbs`` as pages with a breadcrumb list each."""
    pages: dict[str, list] = {}
    for url, _, _, position, name, item in TABLES["crumbs"][1]:
        pages.setdefault(url, []).append({"@type": "ListItem", "position": position, "name": name, **({"item": item} if item else {})})
    return [(url, _as_html([{"@context": "https://schema.org", "@type": "BreadcrumbList", "itemListElement": entries}])) for url, entries in pages.items()]


TABLES["ld_pages"] = ("url string, html string", _ld_pages())
TABLES["crumb_pages"] = ("url string, html string", _crumb_pages())


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def values_sql(name: str) -> str:
    """``name(columns) AS (VALUES ...)`` for a WITH clause."""
    schema, rows = TABLES[name]
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    types = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def cell(value, kind):
        if value is None:
            return f"CAST(NULL AS {kind})"
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    body = ", ".join("(" + ", ".join(cell(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return f"{name}({names}) AS (VALUES {body})"
