"""Bounded fetching over HTTP, as a DataFrame operation.

Requests go to addresses that were resolved and checked first, so a name cannot lead into a private network; no proxy is
used.  Redirects are followed by hand.  Bodies are read up to a limit on the wire and another one after decoding."""

from __future__ import annotations

import contextlib
import gzip
import http.client
import io
import socket
import ssl
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import BadUrl, normalize
from ..operators.network import WITH_PRIVATE, class_of
from ..operators.redirects import MAX_REDIRECTS, STATUSES

FETCHED = "url string, method string, status int, error string, redirects int, final_url string, content_type string, headers map<string,string>, body binary, wire_bytes long, hops array<struct<url:string,status:int,location:string>>"


@dataclass(frozen=True)
class Limits:
    """What a fetch may cost."""

    timeout: float = 15.0
    body_bytes: int = 10 << 20
    decoded_bytes: int = 20 << 20
    redirects: int = MAX_REDIRECTS
    per_second: float = 5.0
    agent: str = "pagequarry"
    allow_private: bool = False


class Refused(Exception):
    """A fetch that ends without an answer, by policy or by limit."""


def addresses_of(host: str) -> list[str]:
    return list(dict.fromkeys(info[4][0] for info in socket.getaddrinfo(host, None, type=socket.SOCK_STREAM)))


def permitted(host: str, resolve: Callable[[str], list[str]], allow_private: bool) -> list[str]:
    """The addresses of ``host``; refused if its name or any one of them is."""
    bare = host.lower().rstrip(".").strip("[]")
    if not allow_private and (bare == "localhost" or bare.endswith(".localhost")):
        raise Refused(f"network blocked: {bare} is loopback")
    found = resolve(bare)
    for ip in found:
        kind = class_of(ip)
        if kind not in (WITH_PRIVATE if allow_private else ("public",)):
            raise Refused(f"network blocked: {bare} is {kind}")
    if not found:
        raise Refused(f"no address for {bare}")
    return found


class _Direct(http.client.HTTPConnection):
    """A connection to one of the checked addresses."""

    def __init__(self, host: str, port: int, ips: list[str], timeout: float, context: ssl.SSLContext | None):
        super().__init__(host, port, timeout=timeout)
        self.ips, self.context = ips, context

    def connect(self):
        last = None
        for ip in self.ips:
            try:
                plain = socket.create_connection((ip, self.port), self.timeout)
                self.sock = self.context.wrap_socket(plain, server_hostname=self.host) if self.context else plain
                return
            except OSError as e:
                last = e
        raise last or OSError("no address")


def tls() -> ssl.SSLContext:
    context = ssl.create_default_context()
    context.minimum_version = ssl.TLSVersion.TLSv1_2
    return context


def read_body(answer, encoding: str, limits: Limits) -> tuple[bytes, int]:
    """(decoded body, bytes on the wire) of a response that is read like a file."""
    encoding = encoding.strip().lower()
    if encoding not in ("", "identity", "gzip", "x-gzip"):
        raise Refused(f"unsupported content encoding {encoding}")
    wire = answer.read(limits.body_bytes + 1)
    if len(wire) > limits.body_bytes:
        raise Refused("body too large")
    if encoding in ("", "identity"):
        body = wire
    else:
        try:
            body = gzip.GzipFile(fileobj=io.BytesIO(wire)).read(limits.decoded_bytes + 1)
        except (OSError, EOFError) as e:
            raise Refused(f"invalid gzip body: {e}") from e
    if len(body) > limits.decoded_bytes:
        raise Refused("decoded body too large")
    return body, len(wire)


@dataclass
class Fetcher:
    """Fetches URLs one after the other, spaced out."""

    limits: Limits = field(default_factory=Limits)
    resolve: Callable[[str], list[str]] = addresses_of
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    next_start: float = 0.0

    def _wait(self, deadline: float) -> None:
        pause = self.next_start - self.clock()
        if self.clock() + max(0.0, pause) > deadline:
            raise Refused("timeout")
        if pause > 0:
            self.sleep(pause)
        self.next_start = max(self.next_start, self.clock()) + 1 / self.limits.per_second

    def _ask(self, method: str, url: str, deadline: float):
        self._wait(deadline)
        parts = urlsplit(url)
        ips = permitted(parts.hostname or "", self.resolve, self.limits.allow_private)
        secure = parts.scheme == "https"
        link = _Direct(parts.hostname, parts.port or (443 if secure else 80), ips, max(0.1, deadline - self.clock()), tls() if secure else None)
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        link.request(method, path, headers={"User-Agent": self.limits.agent, "Accept-Encoding": "gzip", "Accept": "text/html, application/xhtml+xml;q=0.9, */*;q=0.5", "Connection": "close"})
        return link, link.getresponse()

    def fetch(self, url: str, method: str = "GET") -> dict:
        """A row of FETCHED."""
        out = {"url": url, "method": method, "status": 0, "error": "", "redirects": 0, "final_url": "", "content_type": "", "headers": {}, "body": None, "wire_bytes": 0, "hops": []}
        deadline = self.clock() + self.limits.timeout
        try:
            here = normalize(url)
            been: set[str] = set()
            while True:
                out["final_url"] = here
                if here in been:
                    raise Refused("redirect loop")
                if len(out["hops"]) > self.limits.redirects:
                    raise Refused("too many redirects")
                been.add(here)
                link, answer = self._ask(method, here, deadline)
                with contextlib.closing(link):
                    out["status"], out["headers"] = answer.status, {k: v for k, v in reversed(answer.getheaders())}
                    place = answer.getheader("Location", "")
                    if answer.status in STATUSES and place:
                        out["hops"].append({"url": here, "status": answer.status, "location": place})
                        out["redirects"] = len(out["hops"])
                        try:
                            here = normalize(place, here)
                        except BadUrl as e:
                            raise Refused(f"invalid url in redirect: {place}") from e
                        continue
                    out["content_type"] = answer.getheader("Content-Type", "").partition(";")[0].strip().lower()
                    if method != "HEAD":
                        if int(answer.getheader("Content-Length") or 0) > self.limits.body_bytes:
                            raise Refused("body too large")
                        out["body"], out["wire_bytes"] = read_body(answer, answer.getheader("Content-Encoding", ""), self.limits)
                    return out
        except BadUrl as e:
            out["error"] = f"invalid url: {e}"
        except Refused as e:
            out["error"] = str(e)
        except TimeoutError:
            out["error"] = "timeout"
        except (OSError, http.client.HTTPException, ValueError) as e:
            out["error"] = f"network: {type(e).__name__}: {e}"
        return out


def fetch_urls(urls: DataFrame, limits: Limits | None = None, tasks: int = 16) -> DataFrame:
    """The answers (FETCHED) to ``urls`` (url, method).  A host's requests go through one task, which spaces them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    own, schema = limits or Limits(), to_arrow_schema(StructType.fromDDL(FETCHED))

    def run(batches):
        import pyarrow as pa

        fetchers = {}
        for batch in batches:
            for url, method in zip(batch.column("url").to_pylist(), batch.column("method").to_pylist(), strict=True):
                host = urlsplit(url or "").netloc
                row = fetchers.setdefault(host, Fetcher(own)).fetch(url or "", method)
                yield pa.RecordBatch.from_pylist([{**row, "headers": list(row["headers"].items())}], schema=schema)

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1))
    return urls.select("url", "method").repartition(tasks, host).mapInArrow(run, FETCHED)
