"""URLs: normal form, resolution, site keys, patterns, resources, traps."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_URL_BYTES = 2048
# Extensions of URLs that are no pages.
RESOURCE_EXTENSIONS = """7z avi avif bmp css csv doc docx eot exe gif gz ico jpeg jpg js json m4a mov mp3 mp4 odt ogg otf pdf png ppt pptx
rar rss svg tar tif tiff ttf txt wav webm webp woff woff2 xls xlsx xml zip""".split()

_UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_PATH = _UNRESERVED | frozenset(b"!$&'()*+,;=:@/")
_QUERY = _PATH | frozenset(b"?")
_HEX = re.compile(rb"%([0-9A-Fa-f]{2})")
_STRAY = re.compile(r"%(?![0-9A-Fa-f]{2})")


class BadUrl(ValueError):
    """The reason is the message: not-http, invalid, credentials, too-long."""


def _percent(text: str, safe: frozenset) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(raw):
        m = _HEX.match(raw, at)
        if m:
            byte = int(m[1], 16)
            out.append(chr(byte) if byte in _UNRESERVED else f"%{byte:02X}")
            at = m.end()
            continue
        out.append(chr(raw[at]) if raw[at] in safe else f"%{raw[at]:02X}")
        at += 1
    return "".join(out)


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        if part not in (".", ".."):
            out.append(part)
            continue
        if part == ".." and len(out) > 1:
            out.pop()
        if i == len(parts) - 1:
            out.append("")
    joined = "/".join(out)
    return joined if joined.startswith("/") or not path.startswith("/") else "/" + joined


def _host(host: str) -> str:
    if not host:
        raise BadUrl("invalid")
    try:
        ip = ipaddress.ip_address(host)
        return f"[{ip.compressed}]" if ip.version == 6 else str(ip)
    except ValueError:
        pass
    if "%" in host:
        raise BadUrl("invalid")
    host = host.removesuffix(".")
    if not host.isascii():
        try:
            import idna

            host = idna.encode(host, uts46=True, transitional=False).decode()
        except ImportError:
            host = host.lower().encode("idna").decode()
        except UnicodeError as e:
            raise BadUrl("invalid") from e
    host = host.lower()
    if not host or len(host) > 253 or not re.fullmatch(r"[a-z0-9._-]+", host) or ".." in host or host.startswith("."):
        raise BadUrl("invalid")
    return host


def _port(scheme: str, port: str) -> str:
    if not port:
        return ""
    if not re.fullmatch(r"[0-9]+", port):
        raise BadUrl("invalid")
    number = int(port)
    if not 0 < number <= 65535:
        raise BadUrl("invalid")
    return "" if number == {"http": 80, "https": 443}[scheme] else f":{number}"


def normalize(url: str, base: str | None = None) -> str:
    """The normal absolute http(s) form of ``url``, resolved against ``base`` as a browser would; raises BadUrl."""
    text = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(0x21)))))
    text = _STRAY.sub("%25", text)
    if len(text.encode("utf-8", "surrogatepass")) > MAX_URL_BYTES:
        raise BadUrl("too-long")
    try:
        parts = urlsplit(urljoin(base, text) if base else text)
        netloc = parts.netloc
    except ValueError as e:
        raise BadUrl("invalid") from e
    scheme = parts.scheme.lower()
    if scheme not in ("http", "https"):
        raise BadUrl("not-http" if scheme else "invalid")
    if "@" in netloc:
        raise BadUrl("credentials")
    bracket = re.fullmatch(r"\[([^\]]*)\](?::(.*))?", netloc)
    host, _, port = (bracket[1], "", bracket[2] or "") if bracket else netloc.partition(":")
    path = _without_dots(_percent(parts.path, _PATH)) or "/"
    out = f"{scheme}://{_host(host)}{_port(scheme, port)}{path}"
    if parts.query:
        out += "?" + _percent(parts.query, _QUERY)
    if len(out) > MAX_URL_BYTES:
        raise BadUrl("too-long")
    return out


def try_normalize(url: str | None, base: str | None = None) -> str:
    """The normal form, or an empty string."""
    try:
        return normalize(url, base) if url is not None else ""
    except BadUrl:
        return ""


def site_key_of(url: str) -> str:
    """Host without one leading www., and a port that is not the scheme's."""
    parts = urlsplit(url)
    host = (parts.hostname or "").removeprefix("www.")
    port = parts.netloc.rpartition(":")[2] if re.search(r":\d+$", parts.netloc) else ""
    return host + (f":{port}" if port and (parts.scheme, port) not in (("http", "80"), ("https", "443")) else "")


def is_resource(url: str) -> bool:
    return urlsplit(url).path.rpartition("/")[2].rpartition(".")[2].lower() in RESOURCE_EXTENSIONS and "." in urlsplit(url).path.rpartition("/")[2]


# ---------------------------------------------------------------- column forms


def normal_url(url: Column, base: Column | None = None) -> Column:
    """``try_normalize`` as an Arrow UDF."""

    @F.pandas_udf("string")
    def alone(u):
        return u.map(lambda x: try_normalize(x))

    @F.pandas_udf("string")
    def against(u, b):
        import pandas as pd

        return pd.Series([try_normalize(x, y) for x, y in zip(u, b, strict=True)])

    return alone(url) if base is None else against(url, base)


def site_key(url: Column) -> Column:
    """Site key of a normal URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#:]*:([0-9]+)", 1)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.when(own, "").otherwise(F.concat(F.lit(":"), port)))


def in_scope(url: Column, site: Column) -> Column:
    """Does a normal URL belong to the site of that key?"""
    return site_key(url) == site


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_pattern(url: Column) -> Column:
    """Digit runs become {n}; of the query only the sorted keys stay."""
    keys = F.array_sort(F.transform(F.split(query_of(url), "&"), lambda p: F.regexp_replace(F.substring_index(p, "=", 1), "[0-9]+", "{n}")))
    path = F.regexp_replace(path_of(url), "[0-9]+", "{n}")
    return F.when(query_of(url) == "", path).otherwise(F.concat(path, F.lit("?"), F.array_join(keys, "&")))


def is_resource_url(url: Column) -> Column:
    return F.lower(F.regexp_extract(path_of(url), r"\.([^./]*)$", 1)).isin(RESOURCE_EXTENSIONS)
