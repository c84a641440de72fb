"""Sitemaps and sitemap indexes as rows of entries and warnings."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from datetime import datetime
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
MAX_ENTRIES, MAX_LOC, MAX_WARNINGS, MAX_FILE_BYTES = 50_000, 2048, 20, 50 << 20
FIELDS = "kind string, entries array<struct<loc:string,lastmod:string>>, warnings array<string>, truncated boolean, gzip boolean, error string, invalid boolean"
_W3C = re.compile(r"\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2}))?)?)?")


def is_lastmod(text: str) -> bool:
    """A W3C date or time that exists."""
    if not _W3C.fullmatch(text):
        return False
    full = {4: f"{text}-01-01", 7: f"{text}-01"}.get(len(text), text)
    try:
        datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", full).replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


def is_packed(data: bytes, url: str = "", content_type: str = "") -> bool:
    """Is a file gzip: by its first bytes, its type, or its name where it does not begin like XML?"""
    kind = content_type.partition(";")[0].strip().lower()
    named = url.lower().partition("?")[0].endswith(".gz") and data.strip()[:1] not in (b"", b"<")
    return data[:2] == b"\x1f\x8b" or kind in ("application/gzip", "application/x-gzip") or named


def unpacked(data: bytes, most: int = MAX_FILE_BYTES, packed: bool | None = None) -> tuple[bytes, bool, bool]:
    """(bytes, was gzip, over the limit)."""
    if not (is_packed(data) if packed is None else packed):
        return data[: most + 1], False, len(data) > most
    try:
        out = gzip.GzipFile(fileobj=io.BytesIO(data)).read(most + 1)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError(f"gzip: {e}") from e
    return out, True, len(out) > most


def parse_sitemap(data: bytes, url: str = "", content_type: str = "") -> dict:
    packed = is_packed(data, url, content_type)
    out: dict = {"kind": None, "entries": [], "warnings": [], "truncated": False, "gzip": packed, "error": None, "invalid": False}

    def fail(message, invalid=True):
        out.update(error=message, invalid=invalid, entries=[])
        return out

    def warn(message):
        if len(out["warnings"]) < MAX_WARNINGS:
            out["warnings"].append(message)

    try:
        raw, _, over = unpacked(data, packed=packed)
    except ValueError as e:
        return fail(str(e), False)
    if over:
        return fail("decompressed size over the limit", False)
    depth, wanted, loc, lastmod = 0, None, "", ""
    try:
        for event, node in ElementTree.iterparse(io.BytesIO(raw), ("start", "end")):
            space, _, name = node.tag.rpartition("}")
            if event == "start":
                depth += 1
                if depth == 1:
                    if name not in ("urlset", "sitemapindex"):
                        return fail(f"not a sitemap (found {name[:40]!r})")
                    out["kind"], wanted = name, "url" if name == "urlset" else "sitemap"
                    if space.removeprefix("{") != NAMESPACE:
                        warn("unexpected namespace of the root element")
                elif depth == 2:
                    loc = lastmod = ""
                continue
            depth -= 1
            if depth == 2:
                loc, lastmod = (node.text or "", lastmod) if name == "loc" else (loc, node.text or "") if name == "lastmod" else (loc, lastmod)
            elif depth == 1:
                node.clear()
                if name == wanted:
                    _entry(out, warn, wanted, loc.strip(), lastmod.strip())
    except ElementTree.ParseError as e:
        return fail(f"invalid XML: {e}")
    return out


def _entry(out, warn, wanted, loc, lastmod):
    if len(out["entries"]) >= MAX_ENTRIES:
        out["truncated"] = True
    elif not loc:
        warn(f"<{wanted}> without <loc>")
    elif len(loc.encode()) > MAX_LOC:
        warn(f"<loc> longer than {MAX_LOC} bytes")
    else:
        if lastmod and not is_lastmod(lastmod):
            warn(f"invalid <lastmod> {lastmod[:40]!r} for {loc[:200]}")
        out["entries"].append({"loc": loc, "lastmod": lastmod})


def parse_sitemap_files(files: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """``keep`` columns and the parsed fields of each file; body is text or binary.  Columns url and content_type, where
    there are any, help to tell packed files."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([*files.select(*keep).schema.fields, *StructType.fromDDL(FIELDS).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{**{c: r[c] for c in keep}, **parse_sitemap(r["__body"] or b"", r["__url"] or "", r["__type"] or "")}], schema=arrow)

    known = lambda name: (F.col(name) if name in files.columns else F.lit(None)).cast("string")
    return files.select(*keep, F.col(body).cast("binary").alias("__body"), known("url").alias("__url"), known("content_type").alias("__type")).mapInArrow(run, schema)
