"""Exact and near duplicates of extracted text."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hamming, token_simhash
from ..functions.text import tokens
from ..storage import save

NEAR_BITS, PARTS, SHARED, LISTED = 5, 8, 3, 21
#: Of eight parts, five bits touch five at most, so near hashes share three whole parts.
BANDS = list(combinations(range(PARTS), SHARED))
#: Rows of a file that meet in one group; ranges of keys that settle in turn, and hashes up to which all settle at once.
BLOCK, RANGES, FEW = 4096, 16, 20_000


def worded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text hash, words) of the texts that have words."""
    return docs.select(key, F.sha2(F.col(text), 256).alias("sha"), tokens(F.col(text)).alias("words")).where(F.size("words") > 0)


def exact_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(representative, duplicate) of equal texts with words; the smallest key stands for a group."""
    rows = worded(docs, key, text).select(key, "sha")
    first = rows.groupBy("sha").agg(F.min(key).alias("representative"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(first, "sha").where(F.col(key) > F.col("representative")).select("representative", F.col(key).alias("duplicate"))


def listed(groups: DataFrame, most: int = LISTED) -> DataFrame:
    """(representative, duplicates, n): the first ``most`` duplicates of each representative and how many there are, so a
    group of any size stays one small row."""
    sizes = groups.groupBy("representative").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("representative").orderBy("duplicate"))
    few = groups.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("representative").agg(F.sort_array(F.collect_list("duplicate")).alias("duplicates"))
    return few.join(sizes, "representative")


def representatives(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): one row for each distinct text with words, that with the smallest key."""
    rows = worded(docs, key, text)
    return rows.groupBy("sha").agg(F.min_by("words", key).alias("words"), F.min(key).alias(key)).select(key, "words")


def document_simhash(docs: DataFrame, key: str) -> DataFrame:
    """(key, simhash) of rows (key, words)."""
    return token_simhash(docs, key, "words")


def _filed(hashes: DataFrame) -> DataFrame:
    """Rows of ``hashes`` (h and more) under every three of the hash's eight parts: (h, ..., parts, value).

    ``parts`` has bit 8 p for part p, ``value`` the bits of those parts."""
    places = [sum(1 << (8 * p) for p in parts) for parts in BANDS]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    files = F.array(*[F.struct(F.lit(m).cast("long").alias("parts"), F.col("h").bitwiseAND(F.lit(signed(255 * m)).cast("long")).alias("value")) for m in places])
    return hashes.select(*hashes.columns, F.explode(files).alias("f")).select(*hashes.columns, "f.*")


def _dealt(h: Column) -> Column:
    """The hash with its eight bytes transposed as a matrix of bits, which keeps distances: common words give neighbouring
    bits in common, and so every part gets bits from all over the hash."""
    for by, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = h.bitwiseXOR(F.shiftrightunsigned(h, by)).bitwiseAND(F.lit(mask))
        h = h.bitwiseXOR(t).bitwiseXOR(F.shiftleft(t, by))
    return h


def _met(left: DataFrame, right: DataFrame, bits: int = NEAR_BITS, block: int = BLOCK) -> DataFrame:
    """Rows of ``left`` (ha and more) beside those of ``right`` (hb and more) within ``bits`` bits, with their distance.

    Hashes meet in the file of the first three parts that they share.  Of a file of more than ``block`` rows on the right
    each block is a group of its own.  The files are 56 times the rows that they are made of, which no estimate of size
    knows, so neither side may be broadcast."""
    if bits > PARTS - SHARED:
        raise ValueError(f"at most {PARTS - SHARED} bits")
    lefts, rights = (_filed(d.withColumn("h", _dealt(F.col(h)))) for d, h in ((left, "ha"), (right, "hb")))
    large = save(rights.groupBy("parts", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("parts", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    if large.limit(1).count():
        blocks = F.coalesce("blocks", F.lit(1))
        lefts = lefts.join(F.broadcast(large), ["parts", "value"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
        rights = rights.join(F.broadcast(large), ["parts", "value"], "left").withColumn("block", F.pmod(F.hash("h"), blocks)).drop("blocks")
    lefts, rights = lefts.withColumnRenamed("h", "pa"), rights.withColumnRenamed("h", "pb")
    apart = F.col("pa").bitwiseXOR(F.col("pb"))
    folded = apart
    for by in (4, 2, 1):
        folded = folded.bitwiseOR(F.shiftrightunsigned(folded, by))
    ones = F.lit(sum(1 << (8 * p) for p in range(PARTS))).cast("long")
    same = rest = ones.bitwiseAND(F.bitwise_not(folded))  # bit 8 p: both have part p
    for _ in range(SHARED):
        rest = rest.bitwiseAND(rest - 1)
    near = (hamming(F.col("pa"), F.col("pb")) <= bits) & (same.bitwiseXOR(rest) == F.col("parts"))
    keys = [c for c in ("parts", "value", "block") if c in rights.columns]
    met = lefts.join(rights.hint("merge"), keys).where(near)
    return met.withColumn("distance", hamming(F.col("pa"), F.col("pb"))).drop(*keys, "pa", "pb")


def near_pairs(hashes: DataFrame, key: str, bits: int = NEAR_BITS) -> DataFrame:
    """(a, b, distance) with a < b within ``bits`` bits."""
    left, right = hashes.select(F.col(key).alias("a"), F.col("simhash").alias("ha")), hashes.select(F.col(key).alias("b"), F.col("simhash").alias("hb"))
    return _met(left, right, bits).where("a < b").select("a", "b", "distance")


def near_links(hashes: DataFrame, key: str) -> DataFrame:
    """(key, class_id, links): the smallest key of the page's hash, and how many other pages are near.

    Pairs grow faster than pages; here they are counted where they meet and none is written."""
    heads = save(hashes.groupBy("simhash").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n")))
    met = _met(heads.select(F.col("simhash").alias("ha")), heads.select(F.col("simhash").alias("hb"), "n")).where("ha <> hb")
    more = met.groupBy(F.col("ha").alias("simhash")).agg(F.sum("n").alias("near"))
    counts = heads.join(more, "simhash", "left").select("simhash", "class_id", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links"))
    return hashes.join(save(counts), "simhash").select(key, "class_id", "links")


def leader_groups(pairs: DataFrame) -> DataFrame:
    """(representative, duplicate): in key order a page joins its first near representative, else becomes one.

    Resolved in rounds, without one task seeing all pages.  A page whose smaller neighbours are all settled is
    settled: it joins its least leader among them or leads.  Each round settles at least the smallest open page of
    every component, in practice nearly all, and leaves only the edges of open pages to the next; pages without near
    neighbours take no part."""
    edges = save(pairs.select("a", "b"))  # a < b
    nodes = edges.select(F.col("a").alias("k")).union(edges.select("b")).distinct()
    state = save(nodes.join(edges, F.col("k") == F.col("b"), "left_anti").select("k", F.lit(None).cast(nodes.schema["k"].dataType).alias("leader")))
    done, waiting = [state], edges
    while True:
        # Of the edges whose larger end is open, those to settled pages give up what they know.
        waiting = save(waiting.join(state, F.col("b") == F.col("k"), "left_anti").select("a", "b", *([] if "leads" not in waiting.columns else ["leads"])))
        if not waiting.limit(1).count():
            break
        known = state.select(F.col("k").alias("k_"), F.col("leader").isNull().alias("leads_"))
        own = F.col("leads") if "leads" in waiting.columns else F.lit(None).cast("boolean")
        waiting = save(waiting.join(known, F.col("a") == F.col("k_"), "left").select("a", "b", F.coalesce(own, "leads_").alias("leads")))
        judged = waiting.groupBy("b").agg(F.min(F.when(F.col("leads"), F.col("a"))).alias("leader"), F.min(F.when(F.col("leads").isNull(), F.col("a"))).alias("waits"))
        state = save(judged.where(F.col("waits").isNull() | (F.col("leader") < F.col("waits"))).select(F.col("b").alias("k"), "leader"))
        done.append(state)
    joined = reduce(DataFrame.union, done).where("leader is not null")
    return joined.select(F.col("leader").alias("representative"), F.col("k").alias("duplicate"))


def near_groups(hashes: DataFrame, key: str, few: int = FEW) -> DataFrame:
    """(representative, duplicate): leader groups of all pages.

    Pages of one hash have the same near pages, so only the one with the smallest key takes part in pairs and rounds, and
    the others go where it goes: a hash on any number of pages costs one row there.

    Of more than ``few`` hashes the first sixteenth by key settles first; what is near its leaders joins the least of them
    and is done.  Then the next sixteenth, eighth, fourth and half: no pairs are made in a crowd but those of its leaders."""
    heads = save(hashes.groupBy("simhash").agg(F.min(key).alias(key)))
    ends = [1, 2, 4, 8, RANGES] if heads.count() > few else [1]
    waiting = save(heads.repartitionByRange(ends[-1], key).withColumn("part", F.spark_partition_id()))
    done = []
    for end in ends:
        batch, rest = waiting.where(F.col("part") < end), waiting.where(F.col("part") >= end)
        led = save(leader_groups(near_pairs(batch, key)))
        done.append(led)
        if end == ends[-1]:
            break
        leaders = batch.join(led, F.col(key) == F.col("duplicate"), "left_anti").select(F.col(key).alias("leader"), F.col("simhash").alias("hb"))
        joined = _met(rest.select(F.col("simhash").alias("ha")), save(leaders)).groupBy("ha").agg(F.min("leader").alias("leader"))
        judged = save(rest.join(joined, F.col("simhash") == F.col("ha"), "left").select(key, "simhash", "part", "leader"))
        done.append(judged.where("leader is not null").select(F.col("leader").alias("representative"), F.col(key).alias("duplicate")))
        waiting = judged.where("leader is null").drop("leader")
    groups = reduce(DataFrame.union, done)
    led = heads.join(groups, F.col(key) == F.col("duplicate"), "left").select(F.col("simhash").alias("hash"), F.coalesce("representative", key).alias("representative"))
    rows = hashes.join(save(led), F.col("simhash") == F.col("hash"))
    return rows.where(F.col(key) != F.col("representative")).select("representative", F.col(key).alias("duplicate"))
