"""Network classes of addresses and the policy on them; fetch errors; request spacing."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prefixes in order of precedence, by class.
METADATA = ["169.254.169.254/32", "169.254.170.2/32", "100.100.100.200/32", "fd00:ec2::254/128"]
PREFIXES = """0.0.0.0/8 unspecified, 10.0.0.0/8 private, 100.64.0.0/10 shared, 127.0.0.0/8 loopback, 169.254.0.0/16 link-local,
172.16.0.0/12 private, 192.0.0.0/24 reserved, 192.0.2.0/24 reserved, 192.88.99.0/24 reserved, 192.168.0.0/16 private,
198.18.0.0/15 reserved, 198.51.100.0/24 reserved, 203.0.113.0/24 reserved, 224.0.0.0/4 multicast, 255.255.255.255/32 broadcast,
240.0.0.0/4 reserved, ::/128 unspecified, ::1/128 loopback, ::/96 reserved, 64:ff9b:1::/48 private, 100::/64 reserved,
2001::/32 reserved, 2001:10::/28 reserved, 2001:20::/28 reserved, 2001:db8::/32 reserved, 3fff::/20 reserved, 5f00::/16 reserved,
fc00::/7 private, fe80::/10 link-local, fec0::/10 private, ff00::/8 multicast"""
WITH_PRIVATE = ("public", "loopback", "private", "link-local", "shared")
ERROR_KINDS = ("blocked", "redirect-loop", "too-many-redirects", "too-large", "timeout", "unsupported-encoding", "invalid-url", "canceled", "network")


def prefix_rows() -> list[tuple]:
    """(ord, version, low, high, class); addresses as 32 hex digits, which compare as numbers do."""
    named = [(p, "metadata") for p in METADATA] + [tuple(x.split()) for x in PREFIXES.replace("\n", " ").split(", ")]
    out = []
    for i, (prefix, kind) in enumerate(named):
        net = ipaddress.ip_network(prefix)
        out.append((i, net.version, f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}", kind))
    # What no prefix names: public, but of IPv6 only 2000::/3.
    rest = [(len(out), 4, "0" * 32, "f" * 32, "public"), (len(out) + 1, 6, f"{0x2 << 124:032x}", f"{(0x4 << 124) - 1:032x}", "public"), (len(out) + 2, 6, "0" * 32, "f" * 32, "reserved")]
    return out + rest


def address_key(text: str | None) -> tuple[int, str]:
    """(version, 32 hex digits); an IPv4 address inside an IPv6 one (mapped, NAT64, 6to4) counts as itself."""
    try:
        ip = ipaddress.ip_address((text or "").partition("%")[0])
    except ValueError:
        return (0, "")
    if ip.version == 6:
        number = int(ip)
        metadata = {int(ipaddress.ip_network(p).network_address) for p in METADATA}
        inner = ip.ipv4_mapped
        if inner is None and number not in metadata:
            inner = ipaddress.ip_address(number & 0xFFFFFFFF) if number >> 32 == 0x64FF9B << 64 else ip.sixtofour
        ip = inner or ip
    return ip.version, f"{int(ip):032x}"


def class_of(ip: str) -> str:
    """The class of one address, as ``classify`` gives it for many."""
    version, key = address_key(ip)
    return next((kind for _, v, low, high, kind in prefix_rows() if v == version and low <= key <= high), "reserved")


def classify(addresses: DataFrame, ip: str) -> DataFrame:
    """``addresses`` with ``ip_class``: the first prefix that holds the address (a range join with 38 rows)."""
    spark = addresses.sparkSession

    @F.pandas_udf("struct<version:int,key:string>")
    def keyed(s):
        import pandas as pd

        return pd.DataFrame([address_key(x) for x in s], columns=["version", "key"])

    table = spark.createDataFrame(prefix_rows(), "ord int, version int, low string, high string, kind string")
    rows = addresses.select(ip).distinct().withColumn("k", keyed(F.col(ip)))
    cond = (F.col("k.version") == F.col("version")) & F.col("k.key").between(F.col("low"), F.col("high"))
    first = rows.join(F.broadcast(table), cond, "left").groupBy(ip).agg(F.coalesce(F.min_by("kind", "ord"), F.lit("reserved")).alias("ip_class"))
    return addresses.join(first, ip)


def is_permitted(ip_class: Column, allow_private: bool = False) -> Column:
    return ip_class.isin(*(WITH_PRIVATE if allow_private else ("public",)))


def host_class(host: Column) -> Column:
    """loopback for names that always mean the local machine, else null; addresses are for ``classify``."""
    bare = F.regexp_replace(F.lower(host), r"\.$", "")
    return F.when((bare == "localhost") | bare.endswith(".localhost"), "loopback")


def host_verdicts(resolved: DataFrame, allow_private: bool = False) -> DataFrame:
    """(host, permitted, blocked_class) of rows (host, ip), a row for each address of a host (null: none found).

    A host is refused if its name is, or if any of its addresses is; the class named is the least of those."""
    rows = classify(resolved.where("ip is not null"), "ip").select("host", F.when(~is_permitted(F.col("ip_class"), allow_private), F.col("ip_class")).alias("blocked"))
    named = resolved.select("host", (F.lit(None).cast("string") if allow_private else host_class(F.col("host"))).alias("blocked"))
    return rows.union(named).groupBy("host").agg(F.min("blocked").alias("blocked_class")).select("host", F.col("blocked_class").isNull().alias("permitted"), "blocked_class")


def error_kind(error: Column) -> Column:
    """One of ERROR_KINDS from an error's text; empty without an error."""
    low = F.lower(error)
    has = lambda *words: F.lit(False) if not words else low.rlike("|".join(words))
    return (
        F.when(F.coalesce(error, F.lit("")) == "", "")
        .when(has("blocked"), "blocked")
        .when(has("redirect loop"), "redirect-loop")
        .when(has("too many redirects"), "too-many-redirects")
        .when(has("too large", "limit exceeded"), "too-large")
        .when(has("unsupported.*encoding"), "unsupported-encoding")
        .when(has("unsupported url", "invalid url"), "invalid-url")
        .when(has("timeout", "timed out", "deadline"), "timeout")
        .when(has("cancel"), "canceled")
        .otherwise("network")
    )


def spaced_starts(requests: DataFrame, key: str, at: str, order: list[str], interval: int) -> DataFrame:
    """``requests`` with ``start``: the time each may start, at least ``interval`` after the one before of its key.

    start_k = max(at_k, start_(k-1) + interval) has the closed form k * interval + max over j <= k of (at_j - j * interval)."""
    w = Window.partitionBy(key).orderBy(*order)
    n = F.row_number().over(w)
    lead = F.max(F.col(at) - F.col("n_") * interval).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return requests.withColumn("n_", n).withColumn("start", F.col("n_") * interval + lead).drop("n_")
