"""Pages parsed from HTML: one struct for each fetched document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame

from ..functions.urls import is_resource, site_key_of, try_normalize
from .dom import Node, parse_html
from .structured import FACTS, StructuredData

# How much of a page is kept.
MAX_TEXT, MAX_HEADINGS, MAX_LINKS, MAX_IMAGES, MAX_CANONICALS, MAX_ROBOTS, MAX_SOCIAL, MAX_ALTERNATES = 1024, 500, 1000, 500, 20, 20, 10, 100
MAX_MAIN_BYTES, MAX_MAIN_NODES, MAX_MIXED = 64 << 10, 20_000, 20
CHROME = frozenset("head script style noscript nav header footer aside form template svg math".split())
ROBOT_AGENTS = ("robots", "googlebot", "googlebot-news", "bingbot")

STRUCT_FIELDS = f"""titles array<string>, descriptions array<string>, headings array<struct<level:int,text:string>>,
canonicals array<struct<href:string,url:string,source:string,relative:boolean,in_head:boolean,error:string>>,
robots array<struct<source:string,agent:string,value:string>>,
links array<struct<href:string,url:string,external:boolean,resource:boolean,nofollow:boolean,new_tab:boolean,anchor:string>>,
images array<struct<src:string,has_alt:boolean,width:int,height:int,loading:string,alt:string,external:boolean,resource:boolean>>,
hreflangs array<struct<href:string,target:string>>, social array<struct<property:string,value:string>>, lang string,
main_text string, text_bytes long, mixed array<string>, schema_types array<string>, schema_errors array<string>, schema_untyped array<string>,
schema_context array<string>, schema_truncated boolean, {FACTS}"""


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _text(node: Node) -> str:
    skip = ("script", "style", "template")
    return squeeze(" ".join(n.text for n in node.walk(lambda n: n.tag not in skip) if n.tag is None))


def _text_or_alt(node: Node) -> str:
    return _text(node) or " ".join(filter(None, (squeeze(n.attrs.get("alt", "")) for n in node.walk() if n.tag == "img")))


def _has_token(value: str, token: str) -> bool:
    return token in value.lower().split()


def _whole(value: str) -> int:
    return int(value) if re.fullmatch(r"[+-]?[0-9]{1,9}", value) else 0


def link_header_targets(value: str) -> list[str]:
    """Targets of a Link header's entries with rel=canonical."""
    out = []
    for entry in re.findall(r'(?:<[^>]*>|"[^"]*"|[^,])+', value):
        m = re.match(r"\s*<([^>]*)>\s*;(.*)$", entry, re.S)
        for key, _, val in (p.partition("=") for p in m[2].split(";")) if m else ():
            if key.strip().lower() == "rel" and _has_token(val.strip().strip('"'), "canonical"):
                out.append(m[1])
    return out


def header_robots(value: str) -> tuple[str, str]:
    """(agent, directives) of an X-Robots-Tag value."""
    name, colon, rest = value.partition(":")
    name = name.strip().lower()
    known = ("max-snippet", "max-image-preview", "max-video-preview", "unavailable_after")
    return (name, rest) if colon and name not in known and not re.search(r"[ ,]", name) else ("robots", value)


def charset_of(raw: bytes, headers: dict[str, str] | None = None) -> str:
    """The encoding of a page's bytes: by byte order mark, Content-Type, a meta element in the first 1,024 bytes, or else
    UTF-8 where the bytes are that and windows-1252 where not."""
    import codecs

    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if raw.startswith(mark):
            return name
    sent = next((v for k, v in (headers or {}).items() if k.lower() == "content-type"), "")
    named = [m[1] for m in re.finditer(r"(?i)charset\s*=\s*[\"']?([^\s;\"'/>]+)", sent)]
    named += [m[1] for m in re.finditer(r"(?is)<meta[^>]*?charset\s*=\s*[\"']?([^\s;\"'/>]+)", raw[:1024].decode("latin-1"))]
    for name in named:
        try:
            found = codecs.lookup(name).name
        except LookupError:
            continue
        # Labels that browsers read as another encoding: ASCII and Latin-1 as windows-1252; a page that could be read for
        # its meta element is not UTF-16.
        return {"ascii": "cp1252", "iso8859-1": "cp1252", "utf-16": "utf-8", "utf-16-le": "utf-8", "utf-16-be": "utf-8"}.get(found, found)
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return "cp1252"
    return "utf-8"


def decoded(raw: bytes, headers: dict[str, str] | None = None) -> str:
    return raw.decode(charset_of(raw, headers), "replace").removeprefix("\ufeff")


class PageParser:
    """Fills one page's struct; ``scope`` is the audited site's key."""

    def __init__(self, url: str, scope: str):
        self.url, self.scope, self.base = url, scope, url
        self.page: dict = {k: [] for k in ("titles", "descriptions", "headings", "canonicals", "robots", "links", "images", "hreflangs", "social", "mixed")}
        self.page["lang"] = None

    def _put(self, field: str, most: int, value) -> None:
        if len(self.page[field]) < most:
            self.page[field].append(value)

    def _place(self, ref: str) -> tuple[str, bool, bool]:
        """(normal URL or '', external, resource)."""
        url = try_normalize(ref, self.base)
        return (url, site_key_of(url) != self.scope, is_resource(url)) if url else ("", False, False)

    def canonical(self, href: str, source: str, in_head: bool) -> None:
        href = href.strip()
        url = try_normalize(href, self.base) if href else ""
        error = None if url else "empty href" if not href else "invalid URL"
        relative = bool(href) and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", href)
        self._put("canonicals", MAX_CANONICALS, {"href": href[:MAX_TEXT], "url": url, "source": source, "relative": relative, "in_head": in_head, "error": error})

    def robots(self, source: str, agent: str, value: str) -> None:
        self._put("robots", MAX_ROBOTS, {"source": source, "agent": agent, "value": squeeze(value)[:MAX_TEXT]})

    def parse(self, html: str, headers: dict[str, str] | None = None, parts=("main", "structured"), closed: bool = False) -> dict:
        """``parts``: what to look for beside the elements' own fields."""
        root = parse_html(html, closed)
        base = next((n.attrs["href"] for n in root.walk() if n.tag == "base" and "href" in n.attrs), None)
        if base is not None:
            joined = urljoin(self.url, base.strip())
            self.base = joined if urlsplit(joined).scheme in ("http", "https") else self.base
        headings = frozenset(f"h{i}" for i in range(1, 7))
        for node in root.walk(lambda n: n.tag != "template" and n.tag not in headings):
            if node.tag and not node.foreign:
                self._element(node, headings)
        for name, value in (headers or {}).items():
            if name.lower() == "link":
                for target in link_header_targets(value):
                    self.canonical(target, "header", True)
            elif name.lower() == "x-robots-tag":
                agent, directives = header_robots(value)
                self.robots("header", agent, directives)
        return {**self.page, **(main_content(root) if "main" in parts else {}), **(self._structured(root) if "structured" in parts else {})}

    def _element(self, node: Node, headings) -> None:
        tag, a = node.tag, node.attrs
        in_head = lambda: any(n.tag == "head" for n in node.ancestors())
        if tag == "html":
            self.page["lang"] = a.get("lang")
        elif tag == "title":
            if in_head() or not self.page["titles"]:
                self.page["titles"].append(_text(node)[:MAX_TEXT])
        elif tag == "meta":
            self._meta(a)
        elif tag in headings:
            self._put("headings", MAX_HEADINGS, {"level": int(tag[1]), "text": _text_or_alt(node)[:MAX_TEXT]})
        elif tag == "link":
            if _has_token(a.get("rel", ""), "canonical"):
                self.canonical(a.get("href", ""), "html", in_head())
            elif _has_token(a.get("rel", ""), "alternate") and "hreflang" in a:
                url = try_normalize(a["href"].strip(), self.base) if a.get("href", "").strip() else ""
                if url:
                    self._put("hreflangs", MAX_ALTERNATES, {"href": url, "target": a["hreflang"].strip()})
        elif tag == "a" and a.get("href", "").strip():
            url, external, resource = self._place(a["href"].strip())
            rel = a.get("rel", "").lower().split()
            nofollow = any(r in rel for r in ("nofollow", "sponsored", "ugc"))
            self._put("links", MAX_LINKS, {"href": a["href"].strip(), "url": url, "external": external, "resource": resource, "nofollow": nofollow, "new_tab": a.get("target", "").lower() == "_blank", "anchor": _text_or_alt(node)[:MAX_TEXT]})
        elif tag == "img" and a.get("src", "").strip():
            url, external, resource = self._place(a["src"].strip())
            self._put("images", MAX_IMAGES, {"src": url, "has_alt": "alt" in a, "width": _whole(a.get("width", "")), "height": _whole(a.get("height", "")), "loading": a.get("loading", "").lower(), "alt": squeeze(a.get("alt", ""))[:MAX_TEXT], "external": external, "resource": resource})
        if tag in ("img", "script", "iframe", "audio", "video", "source") and self.url.startswith("https:") and a.get("src", "").strip().lower().startswith("http://"):
            self._put("mixed", MAX_MIXED, a["src"])

    def _meta(self, a: dict[str, str]) -> None:
        name, prop, content = a.get("name", "").strip().lower(), a.get("property", "").strip().lower(), a.get("content", "")
        if name == "description":
            self.page["descriptions"].append(squeeze(content)[:MAX_TEXT])
        elif name in ROBOT_AGENTS:
            self.robots("meta", name, content)
        elif prop.startswith("og:") or name.startswith("twitter:"):
            self._put("social", MAX_SOCIAL, {"property": prop if prop.startswith("og:") else name, "value": squeeze(content)[:MAX_TEXT]})

    def _structured(self, root: Node) -> dict:
        data = StructuredData()
        for node in root.walk(lambda n: n.tag not in ("template", "script")):
            if node.tag == "script" and not node.foreign and node.attrs.get("type", "").partition(";")[0].strip().lower() == "application/ld+json":
                if data.blocks >= MAX_BLOCKS:
                    data.truncated = True
                    continue
                data.add_block("".join(c.text for c in node.children))
        data.add_microdata(root, self.base)
        types = sorted({t for i in [*data.items, *data.micro] for t in i["types"]})
        return {"schema_types": types, "schema_errors": data.errors, "schema_untyped": data.untyped, "schema_context": data.context, "schema_truncated": data.truncated, "schema_items": data.item_facts(), "crumbs": data.crumb_facts()}


MAX_BLOCKS = 50


def main_content(root: Node) -> dict:
    """main_text: of the first main or article outside the page's chrome, else of the document; text_bytes: of all text."""
    target = next((n for n in root.walk(lambda n: n.tag not in CHROME) if n.tag in ("main", "article")), root)
    hidden = lambda n: n.tag in CHROME or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true"
    parts, size = [], 0
    for count, node in enumerate(target.walk(lambda n: not hidden(n)), 1):
        if count > MAX_MAIN_NODES or size >= MAX_MAIN_BYTES:
            break
        if node.tag is None:
            raw = node.text.encode("utf-8", "surrogatepass")[: MAX_MAIN_BYTES - size]
            parts.append(raw)
            size += len(raw) + 1
    text = b" ".join(parts).decode("utf-8", "ignore")
    total = sum(len(n.text.encode("utf-8", "surrogatepass")) for n in root.walk() if n.tag is None)
    return {"main_text": re.sub(r"[ \t\r\n]+", " ", text).strip(), "text_bytes": total}


def parse_page(url: str, html: str | bytes, scope: str | None = None, headers: dict[str, str] | None = None, parts=("main", "structured"), closed: bool = False) -> dict:
    url = url or ""
    return PageParser(url, site_key_of(url) if scope is None else scope).parse(decoded(html, headers) if isinstance(html, bytes) else html or "", headers, parts, closed)


def parse_pages(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html", headers: str | None = None, fields=None, closed: bool = False) -> DataFrame:
    """``keep`` columns, ``url`` in normal form, its ``site``, and the struct fields of each page (only ``fields``, if given).
    ``closed``: as of ``parse_html``.

    Each page is its own site's; the html column does not leave the Python worker."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = [c for c in keep if c not in (url, "url", "site")]
    own = [f for f in StructType.fromDDL(STRUCT_FIELDS).fields if fields is None or f.name in fields]
    parts = [name for name, has in (("main", {"main_text", "text_bytes"}), ("structured", {f.name for f in own if f.name.startswith(("schema_", "crumbs"))})) if has & {f.name for f in own}]
    schema = StructType([*pages.select(*wanted).schema.fields, *StructType.fromDDL("url string, site string").fields, *own])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                out = []
                for row in batch.slice(i, 500).to_pylist():
                    own_url = try_normalize(row["__url"]) or (row["__url"] or "")
                    site = site_key_of(own_url)
                    out.append({**{c: row[c] for c in wanted}, "url": own_url, "site": site, **parse_page(own_url, row["__html"], site, dict(row.get("__headers") or {}), parts, closed)})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    given = [F.col(url).alias("__url"), F.col(html).alias("__html"), *([F.col(headers).alias("__headers")] if headers else [])]
    return pages.select(*wanted, *given).mapInArrow(run, schema)
