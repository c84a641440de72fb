"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code point order (null last) weigh ``weights`` in turn and
share ``share`` times all words; a target stops at ``cap`` times its source's
words and the excess goes to the others by weight until none is above.

Curriculum: while the mix runs (t from 0 to 1) a source is drawn at the rate
``target * (1 + tilt * (2t - 1))``.  Its integral, the cumulative demand
``target * ((1 - tilt) t + tilt t**2)``, is inverted in closed form: the copy of
a document whose words stand at ``x`` in the source's queue is trained on when
the demand reaches the middle of it.  The queue is the source's documents by
md5 of id and seed, run through up to ``cap`` times; a copy is taken when its
middle lies below the target, so a source misses its target by half a document
at most, and reruns agree.

Cases: null and empty texts have size 0 and take nothing; a null source is a
source of its own, last; rows that agree in id and size are interchangeable;
an empty table gives an empty mix; more columns are kept by ``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sharding import running_sums
from .storage import materialize, partitions, space_words

WEIGHTS = (5.0, 2.0, 1.0)
#: Heavy sources come early, light ones late.
TILTS = (-0.5, 0.0, 0.5)
SHARE, CAP, SEED = 1.5, 2, "mix-1"
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df`` written once, and broadcast if it has at most BROADCAST_ROWS rows."""
    df = materialize(df, "mix-small")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def source_plan(sizes: DataFrame, share: float = SHARE, cap: int = CAP, weights=WEIGHTS, tilts=TILTS) -> DataFrame:
    """(named, source_size, target, tilt) of ``sizes`` (source, words), a row for each source, in order of sources.

    Water filling without a loop: in order of words by weight the sources fill up one after the other, so the level is
    that of the first source which stays below its cap when all before it have theirs.  Orders and running sums are
    distributed, for there may be as many sources as hosts; only totals and the level come to the driver."""
    total = sizes.agg(F.sum("words")).first()[0] or 0
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("k") % len(values)).cast("int"))
    ordered = running_sums(sizes.select(F.col("source").isNull().alias("last"), "source", "words", F.lit(1).alias("one")), ["last", "source"], "one", "mix-sources")
    numbered = ordered.withColumn("k", F.col("cum") - 1)
    weighed = numbered.select("source", "words", "k", pick(weights).alias("w"), pick(tilts).alias("tilt")).withColumn("ratio", F.col("words") / F.col("w"))
    first = running_sums(weighed.withColumn("most", F.col("words") * cap), ["ratio", "k"], "most", "mix-caps").withColumnRenamed("cum", "caps").drop("pid")
    both = running_sums(first, ["ratio", "k"], "w", "mix-weights").drop("pid")
    heavy = both.agg(F.sum("w")).first()[0] or 0.0
    level = (share * total - (F.col("caps") - F.col("most"))) / (heavy - (F.col("cum") - F.col("w")))
    found = both.withColumn("level", level).where(F.col("level") * F.col("w") <= F.col("most")).agg(F.min(F.struct("ratio", "k", "level")).alias("f")).first()["f"]
    below = F.lit(True) if found is None else (F.col("ratio") < found["ratio"]) | ((F.col("ratio") == found["ratio"]) & (F.col("k") < found["k"]))
    target = F.when(below, F.col("most").cast("double")).otherwise(F.lit(found["level"] if found else 0.0) * F.col("w"))
    return both.select(F.col("source").alias("named"), F.col("words").alias("source_size"), target.alias("target"), "tilt")


def mix(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights=WEIGHTS, tilts=TILTS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, positions (of the copies, 0 to 1)."""
    spark = docs.sparkSession
    rows = materialize(docs.select("doc_id", "source", F.size(space_words(F.col("text"))).cast("long").alias("size"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed))).alias("draw")), "mix-rows")
    plan = source_plan(materialize(rows.groupBy("source").agg(F.sum("size").alias("words")), "mix-sizes"), share, cap, weights, tilts)

    order = ["source", "draw", "doc_id", "size"]
    dealt = materialize(rows.repartitionByRange(partitions(spark), *order).withColumn("pid", F.spark_partition_id()), "mix-dealt")
    sums = dealt.groupBy("source", "pid").agg(F.sum("size").alias("part"))
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("source_"), F.col("pid").alias("pid_"), F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pid", "source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each partition and each source that begins in one; one row for each source
    queued = dealt.join(small(starts), F.col("source").eqNullSafe(F.col("source_")) & (F.col("pid") == F.col("pid_"))).withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    queued = queued.join(small(plan), F.col("source").eqNullSafe(F.col("named")))
    middle = [F.col("start") + F.col("size") / 2 + k * F.col("source_size") for k in range(cap)]
    copies = sum(((m <= F.col("target")) & (F.col("size") > 0)).cast("int") for m in middle)
    positions = F.filter(F.array(*[F.when((m <= F.col("target")) & (F.col("size") > 0), demand_inverse(m / F.col("target"), F.col("tilt"))) for m in middle]), lambda p: p.isNotNull())
    out = queued.withColumn("copies", copies).withColumn("positions", positions)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions")


def demand_inverse(part, tilt):
    """t with (1 - tilt) t + tilt t**2 = part."""
    level = 1 - tilt
    return F.when(tilt == 0, part).otherwise((F.sqrt(level * level + 4 * tilt * part) - level) / (2 * tilt))


def by_position(df: DataFrame, position: str = "position") -> DataFrame:
    """Range-sort: partitions follow each other in training order and are sorted inside."""
    return df.repartitionByRange(partitions(df.sparkSession), position, "doc_id").sortWithinPartitions(position, "doc_id")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents as trained on: a row for each copy taken, in training order, with docs' columns.

    Rows of one id share its copies: each of n such rows gets as many as any of them."""
    names = docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own_id = F.col(f"c{names.index('doc_id')}")
    plan = mix(docs.select("doc_id", "source", "text"), **options).where("copies > 0").groupBy("doc_id").agg(F.max_by("positions", "copies").alias("positions"))
    copies = inner.join(plan, own_id.eqNullSafe(F.col("doc_id"))).select(*inner.columns, "doc_id", F.explode("positions").alias("position"))
    return by_position(copies).select(*inner.columns).toDF(*names)
