"""WARC 1.1 records in ZIP packages, read back by range.

Each task packs its records into one or more ZIP files (web archive packages):
``archive/data.warc.gz`` (a warcinfo record, then one gzip member for each
record) and ``indexes/index.cdx`` (sorted CDXJ lines) are stored members, beside
``pages/pages.jsonl`` and ``datapackage.json``.  A response record holds an HTTP
response with the page as its payload; a revisit record holds the HTTP head only
and names the record it repeats.  A record's id is a UUID (version 8) made of the
page's id and its payload's digest, so records can refer to each other across
packages.

The reader never extracts: it reads a package's tail, parses the end record
(ZIP64 too), the central directory and the local headers, locates every stored
archive member and every index member, and fetches the records that an index
lists by ranges, neighbours in one read.  Archives that no index names are read
from end to end.

Where payloads of at least ``MIN_REVISIT`` bytes are equal, that with the largest
id is a response and the others revisit it.

Cases: null html is an empty payload; smaller payloads are always responses;
rows that share id and payload are written and read back each (they share a
record id, being one capture); rows of one id with different payloads are judged
each by its payload; a null id sorts below any id and is never referred to while
an id is there; a null or blank url is written as ``urn:page:`` and the id; an
empty table writes no package and gives an empty result; more columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean, materialize, new_path, slices

MIN_REVISIT, PACKAGE_BYTES, READ_BYTES = 1000, 128_000_000, 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(folder: str):
    """pyarrow's file system for a folder's address, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


# ---------------------------------------------------------------- records


def record_id(page_id: int | None, digest: str) -> str:
    """64 bits of the page's id, a bit for "has an id" and 57 bits of the digest, around version and variant."""
    bits = ((page_id or 0) % 2**64) << 58 | (page_id is not None) << 57 | int(digest, 16) >> (4 * len(digest) - 57)
    return f"<urn:uuid:{uuid.UUID(int=bits >> 74 << 80 | 8 << 76 | (bits >> 62 & 0xFFF) << 64 | 2 << 62 | bits & (1 << 62) - 1)}>"


def page_of(name: str) -> int | None:
    n = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    bits = n >> 80 << 74 | (n >> 64 & 0xFFF) << 62 | n & (1 << 62) - 1
    number = bits >> 58
    return (number - 2**64 if number >> 63 else number) if bits >> 57 & 1 else None


def target_of(page_id, url: str | None) -> str:
    bare = "".join((url or "").split())
    return quote(bare, safe="!#$%&'()*+,/:;=?@[]~") if bare else f"urn:page:{'' if page_id is None else page_id}"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _framed(fields: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "WARC-Block-Digest": _sha1(block), "Content-Length": str(len(block))}.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Filename": ARCHIVE.rpartition("/")[2], "Content-Type": "application/warc-fields"}
    return _framed(fields, b"software: pagequarry\r\nformat: WARC File Format 1.1\r\n")


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """``digest``: hex SHA-1 of the payload; ``refers_to``: the page whose record a revisit repeats."""
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": target_of(page_id, url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest)}
    return _framed(fields, http_head(len(payload)) + (b"" if kind == "revisit" else payload))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(named fields, block)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record ends early")
    return fields, rest[:size]


def parse_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of an HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, payload


def surt(url: str) -> str:
    """The url in sort-friendly form: the host's labels from last to first, then path and query, lower case."""
    parts = urlsplit(url)
    if not parts.netloc:
        return url.lower()
    host, _, port = parts.netloc.rpartition("@")[2].lower().partition(":")
    labels = host.removeprefix("www.").rstrip(".").split(".")
    port = f":{port}" if port and port != {"http": "80", "https": "443"}.get(parts.scheme) else ""
    return f"{','.join(reversed(labels))}{port}){(parts.path or '/').lower()}{'?' + parts.query.lower() if parts.query else ''}"


# ---------------------------------------------------------------- packages


class Package:
    """Writes one ZIP package to a stream that need not seek."""

    def __init__(self, sink, date: str):
        self.sink, self.date, self.index, self.pages, self.size, self.count = sink, date, [], [], 0, 0
        self.hash = hashlib.sha256()
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self._put(info_record(date))

    def _put(self, raw: bytes) -> tuple[int, int]:
        packed, at = gzip.compress(raw, 6, mtime=0), self.size
        self.member.write(packed)
        self.hash.update(packed)
        self.size += len(packed)
        return at, len(packed)

    def add(self, page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> None:
        at, length = self._put(record(page_id, url, payload, digest, kind, refers_to, self.date))
        target = target_of(page_id, url)
        fields = {"url": target, "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "length": str(length), "offset": str(at), "filename": ARCHIVE.rpartition("/")[2]}
        stamp = "".join(c for c in self.date if c.isdigit())[:14]
        self.index.append(f"{surt(target)} {stamp} {json.dumps(fields)}\n".encode())
        self.pages.append(json.dumps({"url": target, "ts": self.date}) + "\n")
        self.count += 1

    def close(self) -> None:
        self.member.close()
        listed = {INDEX: b"".join(sorted(self.index)), "pages/pages.jsonl": (json.dumps({"format": "json-pages-1.0", "id": "pages", "title": "Pages"}) + "\n" + "".join(self.pages)).encode()}
        about = [{"name": "data.warc.gz", "path": ARCHIVE, "hash": f"sha256:{self.hash.hexdigest()}", "bytes": self.size}]
        for name, raw in listed.items():
            self.zip.writestr(zipfile.ZipInfo(name), raw)
            about.append({"name": name.rpartition("/")[2], "path": name, "hash": f"sha256:{hashlib.sha256(raw).hexdigest()}", "bytes": len(raw)})
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "created": self.date, "resources": about}))
        self.zip.close()
        self.sink.close()


class RangeReader:
    """Reads stored members of a ZIP file by byte ranges of ``read(offset, length)``."""

    END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = {m["name"]: m for m in self._directory()}

    def _end(self) -> tuple[int, int, int]:
        """Entries, size and offset of the central directory."""
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(self.END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(self.END, 0, at)
        if at < 0:
            raise ValueError("no ZIP end record")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if at < 20 and tail_at:
            locator = self.read(tail_at + at - 20, 20)
        else:
            locator = tail[at - 20 : at] if at >= 20 else b""
        if locator[:4] == self.LOCATOR:
            at64 = struct.unpack_from("<Q", locator, 8)[0]
            end64 = self.read(at64, 56)
            if end64[:4] != self.END64:
                raise ValueError("no ZIP64 end record")
            entries, size, offset = struct.unpack_from("<QQQ", end64, 32)
        return entries, size, offset

    def _directory(self):
        entries, size, offset = self._end()
        raw, at = self.read(offset, size), 0
        for _ in range(entries):
            if raw[at : at + 4] != self.CENTRAL:
                raise ValueError("a bad entry in the central directory")
            method, packed, full, n_name, n_extra, n_note, local = struct.unpack_from("<10xH8xII3H8xI", raw, at)
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            full, packed, local = self._wide(extra, full, packed, local)
            yield {"name": name, "method": method, "size": full, "packed": packed, "local": local}
            at += 46 + n_name + n_extra + n_note

    @staticmethod
    def _wide(extra: bytes, full: int, packed: int, local: int) -> tuple[int, int, int]:
        """The ZIP64 extra field has, in this order, those of the three that are all ones."""
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                field = extra[at + 4 : at + 4 + size]
                wide = list(struct.unpack(f"<{size // 8}Q", field[: size // 8 * 8]))
                return tuple(wide.pop(0) if v == 0xFFFFFFFF and wide else v for v in (full, packed, local))
            at += 4 + size
        return full, packed, local

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        member = self.members[name]
        if member["method"] != 0:
            raise ValueError(f"{name} is not stored")
        local = self.read(member["local"], 30)
        if local[:4] != self.LOCAL:
            raise ValueError(f"{name} has no local header")
        return member["local"] + 30 + sum(struct.unpack_from("<HH", local, 26))

    def member(self, name: str) -> bytes:
        member = self.members[name]
        if member["method"] == 8:
            local = self.read(member["local"], 30)
            at = member["local"] + 30 + sum(struct.unpack_from("<HH", local, 26))
            return zlib.decompress(self.read(at, member["packed"]), -15)
        return self.read(self.start(name), member["size"])

    def archives(self) -> list[str]:
        return [n for n in self.members if n.startswith("archive/") and n.endswith((".warc.gz", ".warc"))]

    def listed(self) -> dict[str, list[tuple[int, int]]]:
        """(offset, length) of the records that the package's indexes list, by archive member, in order of offset."""
        found: dict[str, set[tuple[int, int]]] = {}
        by_name = {n.rpartition("/")[2]: n for n in self.archives()}
        for name in self.members:
            if name.startswith("indexes/") and name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
                raw = self.member(name)
                for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).splitlines():
                    at = line.find(b"{")
                    fields = json.loads(line[at:]) if at >= 0 else {}
                    if str(fields.get("filename", "")).rpartition("/")[2] in by_name:
                        found.setdefault(by_name[fields["filename"].rpartition("/")[2]], set()).add((int(fields["offset"]), int(fields["length"])))
        return {name: sorted(places) for name, places in found.items()}

    def records(self, most: int = READ_BYTES):
        """(named fields, block) of every record: those that an index lists, and all of an archive that none names."""
        listed = self.listed()
        for name in self.archives():
            if name in listed:
                yield from self._ranges(name, listed[name], most)
            else:
                yield from self._whole(name, most)

    def _ranges(self, name: str, places: list[tuple[int, int]], most: int):
        base, at = self.start(name), 0
        while at < len(places):
            first, end, stop = places[at][0], places[at][0], at
            while stop < len(places) and places[stop][0] == end and (stop == at or places[stop][0] + places[stop][1] - first <= most):
                end += places[stop][1]
                stop += 1
            raw = self.read(base + first, end - first)
            for offset, length in places[at:stop]:
                own = raw[offset - first : offset - first + length]
                yield parse_record(zlib.decompress(own, 31) if name.endswith(".gz") else own)
            at = stop

    def _whole(self, name: str, most: int):
        """Records one after the other, reading ``most`` bytes at a time."""
        base, size, at = self.start(name), self.members[name]["size"], 0
        held = b""
        unzip = zlib.decompressobj(31)
        while at < size or unzip.unused_data:
            raw = unzip.unused_data if unzip.eof else b""
            unzip = zlib.decompressobj(31) if unzip.eof else unzip
            if not raw:
                raw = self.read(base + at, min(most, size - at))
                at += len(raw)
            held += unzip.decompress(raw) if name.endswith(".gz") else raw
            while held:
                head, blank, rest = held.partition(b"\r\n\r\n")
                length = next((int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")), None) if blank else None
                if length is None or len(rest) < length + 4:
                    break
                whole = len(head) + 4 + length + 4
                yield parse_record(held[:whole])
                held = held[whole:]


# ---------------------------------------------------------------- on Spark


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to)."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_revisit)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(groups, "digest", "left")
    again = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return joined.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("latest")).alias("refers_to"))


def write_packages(rows: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, date: str | None = None) -> DataFrame:
    """Write the rows of ``with_revisits`` as packages below ``folder``; returns the manifest (package, bytes, records).

    ``date``: the capture's time (now).  A package's name has the partition and a number drawn by the attempt, so a task
    that runs again leaves only a file that no manifest names."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        lead = f"{path}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}"
        done, package, name = [], None, ""

        for batch in slices(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                if package is None:
                    name = f"{lead}-{len(done):04d}.wacz"
                    package = Package(fs.open_output_stream(name, compression=None), date)
                package.add(*row)
                if package.size >= package_bytes:
                    package.close()
                    done.append((name, package.size, package.count))
                    package = None
        if package is not None:
            package.close()
            done.append((name, package.size, package.count))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["package", "bytes", "records"])

    return materialize(rows.mapInArrow(lean(pack), "package string, bytes long, records long"), "manifest")


def page_row(fields: dict[str, str], block: bytes) -> tuple | None:
    """(page_id, url, payload_bytes, payload_digest, block, record_type, refers_to) of a page's record; digests of whole
    payloads are checked.  None for other records."""
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    head, payload = parse_http(block)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a damaged record")
    refers = page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    return page_of(fields["warc-record-id"]), fields["warc-target-uri"], int(head["content-length"]), digest, payload, kind, refers


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """Every page record of the packages: page_id, url, payload_bytes, payload_digest (as recorded), block (the payload; empty in
    revisits), record_type, refers_to."""

    def unpack(batches):
        import pyarrow as pa

        fs, _ = filesystem(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "block", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        rows, held = [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for name in batch.column("package").to_pylist():
                with fs.open_input_file(name) as f:
                    reader = RangeReader(lambda at, n, f=f: f.read_at(n, at), f.size())
                    for row in filter(None, (page_row(*r) for r in reader.records())):
                        rows.append(row)
                        held += len(row[4])
                        if len(rows) >= 2000 or held > 8_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, block binary, record_type string, refers_to long"
    spread = manifest.select("package").repartition(max(1, manifest.count()))  # a package is a task's work
    return spread.mapInArrow(lean(unpack), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as packages in the shared folder, then read every record back."""
    folder = new_path(pages.sparkSession, "packages")
    return read_packages(write_packages(with_revisits(pages), folder), folder)


def package_bytes(rows, date: str = "2024-01-31T10:00:00Z") -> bytes:
    """One package in memory; rows as for ``Package.add``."""
    sink = io.BytesIO()
    sink.close, close = (lambda: None), sink.close
    package = Package(sink, date)
    for row in rows:
        package.add(*row)
    package.close()
    out = sink.getvalue()
    close()
    return out
