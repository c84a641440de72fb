"""robots.txt files as rows of rules, sitemaps and warnings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_RULES, MAX_PATTERN, MAX_SITEMAPS, MAX_WARNINGS, MAX_LINE, MAX_AGENT = 500 << 10, 10_000, 2048, 500, 50, 8192, 256
PRODUCT = "pagequarry"

FIELDS = """rules array<struct<grp:int,agents:array<string>,allow:boolean,pattern:string,line:int>>, delays array<struct<agents:array<string>,seconds:double>>,
sitemaps array<struct<url:string,line:int>>, warnings array<struct<line:int,message:string>>, agents array<string>, truncated boolean"""


def normal_pattern(text: str) -> str:
    """Percent-escapes in one form: unreserved bytes plain, others upper-case; controls and non-ASCII escaped."""
    out, raw, i = [], text.encode("utf-8", "surrogatepass"), 0
    while i < len(raw):
        m = re.match(rb"%([0-9A-Fa-f]{2})", raw[i : i + 3])
        byte = int(m[1], 16) if m else raw[i]
        plain = re.fullmatch(r"[A-Za-z0-9._~-]", chr(byte)) if m else 0x20 < byte < 0x7F
        out.append(chr(byte) if plain else f"%{byte:02X}")
        i += 3 if m else 1
    return "".join(out)


def parse_robots(data: bytes) -> dict:
    out: dict = {"rules": [], "delays": [], "sitemaps": [], "warnings": [], "agents": [], "truncated": len(data) > MAX_BYTES}
    text = data[:MAX_BYTES].removeprefix(b"\xef\xbb\xbf")
    group, agents, naming = -1, None, False

    def warn(line, message):
        if len(out["warnings"]) < MAX_WARNINGS:
            out["warnings"].append({"line": line, "message": message})

    for number, raw in enumerate(re.split(rb"\r\n|\r|\n", text), 1):
        if len(raw) > MAX_LINE:
            warn(number, "line too long")
            continue
        line = raw.partition(b"#")[0].decode("utf-8", "replace").strip()
        if not line:
            continue
        key, colon, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            warn(number, "line has no ':' separator")
        elif key in ("user-agent", "useragent", "user agent"):
            if not naming or agents is None:
                group, agents = group + 1, []
            agents.append(value.lower()[:MAX_AGENT])
            out["agents"].append(agents[-1])
            naming = True
        elif key in ("allow", "disallow"):
            naming = False
            if agents is None:
                warn(number, f"{key} outside of a user-agent group")
            elif len(value.encode()) > MAX_PATTERN:
                warn(number, "pattern too long")
            elif value and len(out["rules"]) >= MAX_RULES:
                out["truncated"] = True
            elif value:
                out["rules"].append({"grp": group, "agents": agents, "allow": key == "allow", "pattern": normal_pattern(value), "line": number})
        elif key == "sitemap":
            if value and len(out["sitemaps"]) < MAX_SITEMAPS:
                out["sitemaps"].append({"url": value, "line": number})
        elif key == "crawl-delay":
            naming = False
            try:
                seconds = float(value)
            except ValueError:
                seconds = -1.0
            if agents is None:
                warn(number, "crawl-delay outside of a user-agent group")
            elif not 0 <= seconds <= 86400:
                warn(number, "invalid crawl-delay")
            else:
                out["delays"].append({"agents": agents, "seconds": seconds})
        else:
            warn(number, f"unknown directive {key[:40]!r}")
    return out


def parse_robots_files(files: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """``keep`` columns and the parsed fields of each file; body is text or binary."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [{**{c: r[c] for c in keep}, **parse_robots(r["__body"] or b"")} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([*files.select(*keep).schema.fields, *StructType.fromDDL(FIELDS).fields])
    arrow = to_arrow_schema(schema)
    return files.select(*keep, F.col(body).cast("binary").alias("__body")).mapInArrow(run, schema)
