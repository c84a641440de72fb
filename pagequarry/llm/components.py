"""Connected components of a distributed edge list (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Alternates Kiveris et al.'s star operations; each round's edges are written to the shared folder, and
    only their count and checksum come to the driver."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = _settle(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Least neighbours are written before they are joined, so that the join of a hot node's edges can be split.
        low = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), F.least("a", "low").alias("low")), "low")
        large = materialize(both.join(low, F.col("a") == F.col("at")).where("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "at"), "least")
        joined = large.join(least, F.col("a") == F.col("at"))
        small = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("at", "low")).distinct()
        (now, new), last = _settle(small), now
        discard(last, low, large, least)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _settle(edges: DataFrame):
    edges = materialize(edges, "edges")
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return edges, (r["n"], r["x"])
