"""Document fingerprints by one-permutation MinHash (native DataFrame operations only).

Words are runs of other than ASCII white space, lower-cased; shingles are
five words (all words of a shorter text).  Each shingle is hashed once; the top
8 bits of the hash name one of 256 bins and a bin keeps its least hash.  Empty
bins are filled by optimal densification: bin i looks through all bins in an
order of its own until one is full.  The low 4 bits of each bin are stored as a
hex digit, so a fingerprint is 256 digits; likeness is the share of equal
digits, corrected for the 1 in 16 that agree by chance.

Everything is array expressions on one row: no shuffle to make a fingerprint.

Cases: null and empty texts, and texts of white space, have the empty
fingerprint, which is like itself (1) and unlike any other (0); the next
document is the next distinct (doc_id, text), by id and then by text hash, the
first after the last, so repeated rows get equal results; a null id sorts first,
as the least long, which stands for it, does (that id comes back as null); with a single document the next is itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, partitions, space_words

SHINGLE, BINS, DRAWS = 5, 256, 16
NULL_ID = -(2**63)
GAP = "."


def _first_draw(i):
    return i * 73


def _stride(i):
    return 29 * (2 * i + 1)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as ``name``."""
    w, h, s, o, f, g, e = (f"{name}__{x}" for x in ("words", "hash", "shingles", "sorted", "least", "sparse", "each"))
    df = df.withColumn(w, space_words(F.lower(F.col(text))))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    rolled = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + k) for k in range(1, SHINGLE)]))
    df = df.withColumn(s, F.when(F.size(w) >= SHINGLE, rolled).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>")))
    # Sorted, the hashes of a bin stand together, the least first.
    df = df.withColumn(o, F.sort_array(s))
    df = df.withColumn(f, F.filter(o, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(F.col(o), i - 1), 56))))
    bin_of = lambda x: (F.shiftright(x, 56) + BINS // 2).cast("int")
    digit = lambda x: F.lower(F.hex(x.bitwiseAND(F.lit(15))))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(bin_of(F.get(F.col(f), i - 1)))
    spaced = F.array_join(F.transform(f, lambda x, i: F.concat(F.repeat(F.lit(GAP), bin_of(x) - before(i) - 1), digit(x))), "")
    df = df.withColumn(g, F.rpad(spaced, BINS, GAP))
    df = df.withColumn(e, F.split(g, ""))
    # For each bin the donors in its own order; few bins are still empty after DRAWS, and those take the donor
    # of least rank: the rank of bin j for bin i solves first + rank * stride = j.
    inverse = F.array(*[F.lit(pow(_stride(i), -1, BINS)) for i in range(BINS)])
    full = lambda c: F.when(c != GAP, c)

    def filled(c, i):
        draws = [full(F.get(F.col(e), (_first_draw(i) + F.lit(t) * _stride(i)) % BINS)) for t in range(DRAWS)]
        ranks = F.transform(f, lambda x: F.pmod((bin_of(x) - _first_draw(i)) * F.get(inverse, i), F.lit(BINS)) * 16 + x.bitwiseAND(F.lit(15)).cast("int"))
        rest = F.lower(F.hex(F.array_min(ranks) % 16))
        return F.when(c != GAP, c).otherwise(F.coalesce(*draws, rest))

    dense = F.when(F.size(f) == 0, F.lit("")).when(F.instr(g, GAP) == 0, F.col(g)).otherwise(F.array_join(F.transform(e, filled), ""))
    return df.withColumn(name, dense).drop(w, h, s, o, f, g, e)


def likeness(a: str, b: str):
    """Estimated Jaccard similarity of two fingerprint columns."""
    agree = F.size(F.filter(F.zip_with(F.split(F.col(a), ""), F.split(F.col(b), ""), lambda x, y: x == y), lambda z: z))
    chance = 1 / 16
    estimate = F.greatest(F.lit(0.0), (agree / BINS - chance) / (1 - chance))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col(a) == "") | (F.col(b) == ""), F.lit(0.0)).otherwise(estimate)


def successors(rows: DataFrame) -> DataFrame:
    """Distinct (key_id, key_hash, n_chars, copies) with next_id and next_hash, in a circle by id and hash."""
    spark = rows.sparkSession
    distinct = rows.groupBy("key_id", "key_hash").agg(F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    dealt = materialize(distinct.repartitionByRange(partitions(spark), "key_id", "key_hash").withColumn("pid", F.spark_partition_id()), "order")
    firsts = dealt.groupBy("pid").agg(F.min(F.struct("key_id", "key_hash")).alias("key")).orderBy("pid").collect()  # a row for each partition
    follow = [(r["pid"], nxt["key"]["key_id"], nxt["key"]["key_hash"]) for r, nxt in zip(firsts, [*firsts[1:], *firsts[:1]], strict=True)]
    behind = spark.createDataFrame(follow, "pid int, behind_id bigint, behind_hash bigint")
    inside = Window.partitionBy("pid").orderBy("key_id", "key_hash")
    led = dealt.join(F.broadcast(behind), "pid").withColumn("ahead", F.lead(F.struct("key_id", "key_hash")).over(inside))
    return led.select("key_id", "key_hash", "n_chars", "copies", F.coalesce("ahead.key_id", "behind_id").alias("next_id"), F.coalesce("ahead.key_hash", "behind_hash").alias("next_hash"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text (the last quarter replaced by the next document's head)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key_id"), text.alias("text"))
    base = base.select("key_id", F.xxhash64("text").alias("key_hash"), "text")
    order = materialize(successors(base.select("key_id", "key_hash", F.char_length("text").alias("n_chars"))), "successors")
    # One exchange of the texts serves both joins, for both need the same columns of it.
    marked = with_fingerprint(base, "text", "fingerprint")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    want = order.select(F.col("key_id").alias("own_id"), F.col("key_hash").alias("own_hash"), "next_id", "next_hash", "n_chars", quarter.alias("cut"))
    heads = want.join(marked, (F.col("next_id") == F.col("key_id")) & (F.col("next_hash") == F.col("key_hash"))).select("own_id", "own_hash", "n_chars", "cut", F.substring("text", F.lit(1), F.col("cut")).alias("head"), F.col("fingerprint").alias("next_fingerprint"))
    if order.where("copies > 1").limit(1).count():
        heads = heads.dropDuplicates(["own_id", "own_hash"])
    both = marked.join(heads, (F.col("key_id") == F.col("own_id")) & (F.col("key_hash") == F.col("own_hash")))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("cut")), F.col("head"))
    out = both.select(F.nullif(F.col("key_id"), F.lit(NULL_ID)).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    out = with_fingerprint(out.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
