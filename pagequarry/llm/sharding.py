"""Sharding by minimax contiguous partition (native DataFrame operations only).

Atomic groups (equal texts) stand in the order of their smallest id.  The
smallest shard capacity that fits ``n_shards`` contiguous runs is found by
binary search; each capacity is checked greedily (fill a shard until the next
group would overflow it).  The prefix sums stay distributed: the driver holds
a bounded table of *knots* (known group ends), which brackets every greedy jump
from both sides; only stretches that leave the answer open are looked at again
at a finer grain, so the result is exact however many groups there are.

A group larger than an even share cannot be cut: it gets a shard of its own, at
the end, and the others share the remaining shards evenly.

Cases: null text counts as empty (size 1); empty texts are one group; repeated
rows each get a slot; a null id sorts first; an empty table gives an empty
result; more columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, partitions

#: Knots fetched per look at the prefix sums, in all.
KNOTS = 16384
NULL_ID = -(2**63)


class Knots:
    """Known group ends among 0..total; ``full[i]``: no other end lies between ``pos[i]`` and ``pos[i + 1]``."""

    def __init__(self, total: int):
        self.pos, self.full, self.total = [0, total], [False], total

    def refine(self, found: list[tuple[int, int, int]]) -> None:
        """``found``: (first end, last end, number of ends) of blocks that cover whole open stretches.

        A block's first end follows the known end before it directly, so each open block yields a new knot."""
        known = dict(zip(self.pos[1:], self.full, strict=True))
        for first, last, count in found:
            known[last] = count <= 2
            known[first] = True
        self.pos = [0, *sorted(known)]
        self.full = [known[p] for p in self.pos[1:]]

    def after(self, start: int, capacity: int) -> tuple[int, int]:
        """Least and largest value that the greedy cut after ``start`` can have."""
        goal = start + capacity
        if goal >= self.total:
            return self.total, self.total
        j = bisect_right(self.pos, goal) - 1
        return self.pos[j], self.pos[j] if self.full[j] else min(goal, self.pos[j + 1] - 1)

    def walk(self, capacity: int, shards: int, side: int) -> list[int]:
        at, cuts = 0, []
        for _ in range(shards):
            at = self.after(at, capacity)[side]
            cuts.append(at)
        return cuts

    def smallest(self, low: int, shards: int, side: int) -> int:
        high = self.total
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, side)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def open_between(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = set()
        for a, b in pairs:
            i = max(0, bisect_right(self.pos, a) - 1)
            while i < len(self.full) and self.pos[i] <= b:
                if not self.full[i]:
                    out.add((self.pos[i], self.pos[i + 1]))
                i += 1
        return sorted(out)


def minimax_cuts(look, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """(capacity, cumulative ends of the shards).  ``look(stretches)`` returns (first end, last end,
    number of ends) of finer blocks of the given open stretches."""
    knots = Knots(total)
    if not total:
        return 0, [0] * shards
    knots.refine(look([(0, total)]))
    while True:
        low = max(largest, -(-total // shards))
        least, enough = knots.smallest(low, shards, 1), knots.smallest(low, shards, 0)
        first, last = knots.walk(least, shards, 0), knots.walk(enough, shards, 1)
        if least == enough and first == last:
            return least, first
        knots.refine(look(knots.open_between(list(zip(first, last, strict=True)))))


def binary(value: bytes):
    return F.expr(f"X'{value.hex()}'")


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in stretches:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def running_sums(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``cum``, the sum of ``value`` up to each row in ``order``, without one task seeing all rows."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), *order).withColumn("pid", F.spark_partition_id())
    dealt = materialize(dealt, name)
    sums = dealt.groupBy("pid").agg(F.sum(value).alias("part")).collect()  # a row for each partition
    before, at = [], 0
    for r in sorted(sums, key=lambda r: r["pid"]):
        before.append((r["pid"], at))
        at += r["part"]
    kind = dealt.agg(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
    offsets = spark.createDataFrame([(p, float(x) if kind == "double" else x) for p, x in before], f"pid int, before {kind}")
    inside = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(offsets), "pid").withColumn("cum", F.col("before") + F.sum(value).over(inside)).drop("before")


def assign_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp")),
        "shard-rows",
    )
    groups = materialize(
        rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.coalesce(F.min("doc_id"), F.lit(NULL_ID)).alias("first_id")),
        "shard-groups",
    )
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    giants, shards, rest = [], n_shards, total
    for r in groups.orderBy(F.desc("bytes"), "grp").limit(n_shards - 1).collect():
        if shards > 1 and r["bytes"] * shards > rest:
            giants.append(bytes(r["grp"]))
            shards, rest = shards - 1, rest - r["bytes"]
    small = groups.where(~F.col("grp").isin([binary(g) for g in giants])) if giants else groups
    ordered = materialize(running_sums(small.select("first_id", "grp", "bytes", "n"), ["first_id", "grp"], "bytes", "shard-dealt"), "shard-sums")
    largest = ordered.agg(F.max("bytes")).first()[0] or 0

    def look(stretches):
        ranges = merged(stretches)
        each = max(64, KNOTS // len(ranges))
        blocks = None  # one flat CASE: nested ones take the optimizer exponential time
        for k, (a, b) in enumerate(ranges):
            width = max(1, -(-(b - a) // each))
            here = (F.col("cum") > a) & (F.col("cum") <= b)
            code = F.lit(k * each * 4) + F.floor((F.col("cum") - 1 - a) / width)
            blocks = F.when(here, code) if blocks is None else blocks.when(here, code)
        found = ordered.select("cum", blocks.alias("block")).where("block is not null").groupBy("block").agg(F.min("cum").alias("first"), F.max("cum").alias("last"), F.count(F.lit(1)).alias("n"))
        return [(r["first"], r["last"], r["n"]) for r in found.collect()]  # KNOTS rows at most

    _, ends = minimax_cuts(look, rest, largest, shards)
    # A group's shard is the number of cuts before its end; a cut becomes the key of the first group behind it.
    limits = ordered.where(F.col("cum").isin(sorted(set(ends)))).select("cum", "first_id", "grp").collect()
    last = {r["cum"]: (r["first_id"], bytes(r["grp"])) for r in limits}
    shard = F.lit(0)
    for end in ends[:-1]:
        if end in last:
            first_id, grp = last[end]
            past = (F.col("first_id") > first_id) | ((F.col("first_id") == first_id) & (F.col("grp") > binary(grp)))
            shard = shard + past.cast("int")
    if giants:
        own_shard = None
        for k, grp in enumerate(giants):
            here, number = F.col("grp") == binary(grp), F.lit(n_shards - len(giants) + k)
            own_shard = F.when(here, number) if own_shard is None else own_shard.when(here, number)
        shard = own_shard.otherwise(shard)
    several = groups.where("n > 1").select("grp", F.col("first_id").alias("head"))
    own = F.coalesce("head", "doc_id", F.lit(NULL_ID))
    placed = rows.join(several, "grp", "left").select("doc_id", "size", "text_crc32", "grp", own.alias("first_id")).withColumn("shard", shard.cast("int"))
    return slots(placed.drop("first_id")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def slots(placed: DataFrame) -> DataFrame:
    """Number each shard's rows from 0 by id, in two levels, so that no task holds a whole shard."""
    spark = placed.sparkSession
    order = ["shard", "doc_id", "grp"]
    dealt = materialize(placed.repartitionByRange(partitions(spark), *order).withColumn("pid", F.spark_partition_id()), "shard-slots")
    counts = dealt.groupBy("shard", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pid", "shard").orderBy("doc_id", "grp")
    # offsets has a row for each partition and each shard that begins in one: at most partitions + shards
    return dealt.join(F.broadcast(offsets), ["shard", "pid"]).withColumn("slot", F.col("before") + F.row_number().over(inside) - 1)
