"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet table (line, n_docs, last_doc) in buckets of ``line``, the
128-bit hash of a line's key, each bucket sorted.  Documents arrive in batches of
about ``BATCH_LINES`` lines (``LEAST_BATCHES`` at least).  A batch's lines are
merge-anti-joined with every run: what no run holds becomes a run of level 0, so
a line is in one run only; what some run holds is noted beside the runs as a
repetition.  The batch is dealt by line once, and the runs, being bucketed, do
not move.  When a level holds ``fanout`` runs they are merged into one run of the
next level, so a table of any size costs a logarithmic number of rewrites.
``repeated`` joins the repetitions to the runs and gives the lines that at least
``min_docs`` documents hold.

Cases: null or empty text is one empty line, kept; repeated lines inside a
document count once; rows that share a doc_id are one document, so a line of
theirs is counted once and each row loses or keeps it alike; a null id loses
no line and counts as no document; columns of any name are carried, and
``dedup_lines`` replaces those named like its results; empty tables give empty
results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import ascii_lower, bucketed, discard, materialize, stripped

MIN_CHARS, MIN_DOCS, LEAST_BATCHES, BATCH_LINES, FANOUT = 20, 3, 4, 200_000_000, 2
RESULTS = ("lines", "kept", "n_dropped")


def line_hash(line):
    """128 bits of a line's key: stripped, A-Z lower-cased; null for keys under MIN_CHARS."""
    key = ascii_lower(stripped(line))
    return F.when(F.char_length(key) >= MIN_CHARS, F.unhex(F.md5(key)))


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def summed(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("line").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


class LineRuns:
    """Levels of sorted runs in the shared folder, and what was seen again."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.again: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Rows of ``lines`` whose ``line`` is in no run."""
        for run in self.runs():
            lines = lines.join(run.select("line"), "line", "left_anti")
        return lines

    def seen(self, lines: DataFrame) -> list[DataFrame]:
        """The other rows, by run."""
        return [lines.join(run.select("line"), "line", "left_semi") for run in self.runs()]

    def add(self, batch: DataFrame) -> None:
        """``batch``: distinct (line, doc_id) of documents that came in no earlier batch."""
        own = batch.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if self.runs():
            own = spent = bucketed(own, "line", "line-batch", ordered=True)
            self.again.append(materialize(reduce(DataFrame.unionByName, self.seen(own)), "line-again"))
            if len(self.again) > self.fanout:
                both, self.again = self.again, [materialize(summed(self.again), "line-again")]
                discard(*both)
        else:
            spent = None
        run, level = bucketed(self.unseen(own), "line", "line-run", ordered=True), 0
        if spent is not None:
            discard(spent)
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run, merged = bucketed(reduce(DataFrame.unionByName, self.levels[level]), "line", "line-run", ordered=True), self.levels[level]
            discard(*merged)
            self.levels[level] = []
            level += 1

    def repeated(self, min_docs: int) -> DataFrame:
        if not self.again:
            return reduce(DataFrame.unionByName, self.runs()).where(F.col("n_docs") >= min_docs)
        again = materialize(summed(self.again).select("line", F.col("n_docs").alias("more"), F.col("last_doc").alias("later")), "line-again")
        both = [run.join(again, "line", "left") for run in self.runs()]
        total, last = F.col("n_docs") + F.coalesce("more", F.lit(0)), F.greatest("last_doc", "later")
        return reduce(DataFrame.unionByName, both).select("line", total.alias("n_docs"), last.alias("last_doc")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``lines`` (array), ``kept`` (text) and ``n_dropped``, instead of columns of those names."""
    spark, names = docs.sparkSession, docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    spread = inner.where(own_id.isNotNull()).select(own_id.alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.transform(lines_of(text), line_hash)).alias("pos", "line"))
    held = materialize(spread.where("line is not null"), "line-held")
    batches = batches or max(LEAST_BATCHES, -(-held.count() // BATCH_LINES))
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        runs.add(held.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k).select("line", "doc_id").distinct())
    repeated = materialize(runs.repeated(min_docs).select("line", "last_doc"), "line-repeated")
    gone = held.join(repeated, "line").where("doc_id < last_doc").groupBy("doc_id", "text_key").agg(F.collect_list("pos").alias("gone"))  # positions in one text
    joined = inner.join(gone, (own_id == F.col("doc_id")) & (F.xxhash64(text) == F.col("text_key")), "left").withColumn("lines", lines_of(text))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    out = joined.withColumn("kept_lines", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda k: F.get("lines", k))))
    own = [F.col(f"c{k}").alias(c) for k, c in enumerate(names) if c.lower() not in RESULTS]
    return out.select(*own, "lines", F.array_join("kept_lines", "\n").alias("kept"), (F.size("lines") - F.size("kept_lines")).alias("n_dropped"))
