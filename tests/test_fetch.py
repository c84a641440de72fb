"""Fetching from a server on this machine."""

import gzip
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pagequarry.plans.audit import audit
from pagequarry.plans.live_crawl import live_crawl
from pagequarry.sources.fetch import Fetcher, Limits, Refused, fetch_urls, permitted

LONG = " ".join(f"word{i}" for i in range(60))
PAGES = {
    "/": "<title>The first page of a served site</title><h1>One</h1><a href=/two>two</a><a href=/secret>no</a><a href=/moved>moved</a><a href=/x.pdf>file</a><img src=/pic.png alt=a>" + LONG,
    "/two": "<title>The second page of a served site</title><h1>Two</h1><a href=/three>three</a><a href=/>one</a>" + LONG + " two",
    "/three": "<title>The third page of a served site</title><h1>Three</h1><a href=/four>four</a>" + LONG + " three",
    "/four": "<title>The fourth page</title>",
    "/listed": "<title>Only in the sitemap</title><h1>Listed</h1>" + LONG + " listed",
    "/new": "<title>Where the old page went</title><h1>New</h1>" + LONG + " new",
}
MOVES = {"/moved": "/new", "/a": "/b", "/b": "/a", "/self": "/self#x", "/far": "ftp://h/", **{f"/s{k}": f"/s{k + 1}" for k in range(12)}, "/s12": "/two"}


class Handler(BaseHTTPRequestHandler):
    asked: list = []

    def log_message(self, *args):
        pass

    def do_HEAD(self):
        self.do_GET()

    def do_GET(self):
        Handler.asked.append((self.command, self.path))
        base = f"http://{self.headers['Host']}"
        if self.path in MOVES:
            self.send_response(302)
            self.send_header("Location", MOVES[self.path])
            self.end_headers()
            return
        body, kind, more = None, "text/html; charset=utf-8", {}
        if self.path in PAGES:
            body = f"<html lang=en>{PAGES[self.path]}</html>".encode()
        elif self.path == "/robots.txt":
            body, kind = f"User-agent: *\nDisallow: /secret\nSitemap: {base}/index.xml".encode(), "text/plain"
        elif self.path == "/index.xml":
            body, kind = f"<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>{base}/map.xml.gz</loc></sitemap></sitemapindex>".encode(), "application/xml"
        elif self.path == "/map.xml.gz":
            body, kind = gzip.compress(f"<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>{base}/listed</loc></url></urlset>".encode()), "application/gzip"
        elif self.path == "/gz":
            body, more = gzip.compress(b"plain text"), {"Content-Encoding": "gzip"}
        elif self.path == "/bomb":
            body, more = gzip.compress(b"0" * 2_000_000), {"Content-Encoding": "gzip"}
        elif self.path == "/broken-gz":
            body, more = b"not gzip at all", {"Content-Encoding": "gzip"}
        elif self.path == "/brotli":
            body, more = b"x", {"Content-Encoding": "br"}
        elif self.path == "/large":
            body = b"y" * 50_000
        elif self.path in ("/x.pdf", "/pic.png"):
            body, kind = b"z" * 10, "application/octet-stream"
        self.send_response(200 if body is not None else 404)
        self.send_header("Content-Type", kind)
        for k, v in more.items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body or b"")))
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(body or b"")


@pytest.fixture(scope="module")
def origin():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def near(**more):
    return Limits(allow_private=True, per_second=1000, **more)


def test_one_fetch(origin):
    got = Fetcher(near()).fetch(origin + "/moved")
    assert (got["status"], got["error"], got["redirects"], got["final_url"], got["content_type"]) == (200, "", 1, origin + "/new", "text/html")
    assert got["hops"] == [{"url": origin + "/moved", "status": 302, "location": "/new"}] and b"Where the old" in got["body"] and got["wire_bytes"] == len(got["body"])
    assert Fetcher(near()).fetch(origin + "/gz")["body"] == b"plain text"
    head = Fetcher(near()).fetch(origin + "/x.pdf", "HEAD")
    assert head["status"] == 200 and head["body"] is None
    assert Fetcher(near()).fetch(origin + "/nothing")["status"] == 404


@pytest.mark.parametrize(
    ("path", "limits", "error"),
    [
        ("/a", {}, "redirect loop"),
        ("/self", {}, "redirect loop"),
        ("/s0", {}, "too many redirects"),
        ("/far", {}, "invalid url"),
        ("/brotli", {}, "unsupported content encoding"),
        ("/broken-gz", {}, "invalid gzip"),
        ("/large", {"body_bytes": 49_999}, "body too large"),
        ("/bomb", {"decoded_bytes": 1_000_000}, "decoded body too large"),
    ],
)
def test_limits(origin, path, limits, error):
    got = Fetcher(near(**limits)).fetch(origin + path)
    assert error in got["error"] and got["body"] is None


def test_redirects_up_to_the_limit(origin):
    assert Fetcher(near()).fetch(origin + "/s3")["final_url"] == origin + "/two" and Fetcher(near()).fetch(origin + "/s3")["redirects"] == 10


def test_policy():
    assert permitted("fine.test", lambda h: ["8.8.8.8", "2606:4700::1"], False) == ["8.8.8.8", "2606:4700::1"]
    for host, ips in (("mixed.test", ["8.8.8.8", "10.0.0.1"]), ("localhost", ["8.8.8.8"]), ("a.LOCALHOST.", ["8.8.8.8"]), ("six.test", ["::1"]), ("none.test", []), ("mapped.test", ["::ffff:127.0.0.1"])):
        with pytest.raises(Refused):
            permitted(host, lambda h, ips=ips: ips, False)
    assert permitted("localhost", lambda h: ["127.0.0.1"], True) == ["127.0.0.1"]
    with pytest.raises(Refused):
        permitted("meta.test", lambda h: ["169.254.169.254"], True)
    got = Fetcher(Limits()).fetch("http://127.0.0.1:1/")
    assert got["error"].startswith("network blocked") and got["status"] == 0
    assert Fetcher(Limits()).fetch("ftp://x")["error"].startswith("invalid url") and Fetcher(Limits()).fetch("http://u@h.test/")["error"].startswith("invalid url")


def test_requests_are_spaced():
    now, slept = [0.0], []
    fetcher = Fetcher(Limits(per_second=2, timeout=3), clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)), resolve=lambda h: [])
    for _ in range(3):
        fetcher.fetch("http://h.test/")
    assert slept == [0.5, 0.5]
    fetcher.next_start = 100.0
    assert fetcher.fetch("http://h.test/")["error"] == "timeout"


def test_urls_as_rows(spark, origin):
    df = spark.createDataFrame([(origin + "/two", "GET"), (origin + "/x.pdf", "HEAD"), (None, "GET")], "url string, method string")
    out = {r["url"]: r for r in fetch_urls(df, near(), 2).collect()}
    assert out[origin + "/two"]["status"] == 200 and bytes(out[origin + "/two"]["body"]).startswith(b"<html") and out[origin + "/x.pdf"]["body"] is None and out[""]["error"].startswith("invalid url")


def test_live_crawl_and_audit(spark, origin):
    Handler.asked.clear()
    done = live_crawl(spark, origin + "/", max_depth=2, limits=near())
    rows = {r["url"].removeprefix(origin): r for r in done.corpus.collect()}
    assert {p: r["depth"] for p, r in rows.items()} == {"/": 0, "/two": 1, "/moved": 1, "/x.pdf": 1, "/pic.png": 1, "/listed": 1, "/three": 2}
    assert {(r["url"].removeprefix(origin), r["reason"]) for r in done.skipped.collect()} == {("/secret", "robots-disallowed"), ("/four", "max-depth")} and done.stop_reason == "max-depth"
    assert ("HEAD", "/x.pdf") in Handler.asked and ("GET", "/secret") not in Handler.asked and len(Handler.asked) == len(set(Handler.asked))
    assert {r["url"].removeprefix(origin): r["status"] for r in done.sitemap_files.collect()} == {"/index.xml": 200, "/map.xml.gz": 200, "/sitemap.xml": 404}
    found = {(r["id"], r["url"].removeprefix(origin)) for r in audit(done.corpus, origin + "/", [], done.robots_files, done.sitemap_files).findings.collect()}
    assert {("SEO-HTTP-002", "/moved"), ("SEO-LINK-001", "/listed"), ("WEB-HYGIENE-001", "/two"), ("SEO-DESC-001", "/three")} <= found
    few = live_crawl(spark, origin + "/", max_pages=2, limits=near())
    assert few.corpus.count() == 2 and few.stop_reason == "max-pages"
    shut = live_crawl(spark, origin + "/secret", limits=near())
    assert shut.corpus.count() == 0 and shut.stop_reason == "start-disallowed"
