"""Term weights: zone-weighted TF-IDF, strengths, weak terms, dominant profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import is_keyword, tenths, tokens
from ..storage import save

ZONE_WEIGHTS = {"title": 4, "headings": 3, "description": 2, "body": 1}
#: Counts that leave a Python worker together.
ROWS = 10_000
TOP_TERMS, MAX_TERMS, WEAK_TERMS, DOMINANT, SITE_SHARE, SITE_TOP = 20, 120, 10, 10, 0.5, 20


def token_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token) for each token."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("token"))


def term_counts(docs: DataFrame, key: str, text: str, most: int = 1, dominant: int | None = None) -> DataFrame:
    """(key, term, n) of the 1..most-grams; ``dominant``: only so many of each key, as of ``dominant_terms``.

    A document's words lie in its own row, so they are counted there.  Only the counts of a key that several rows have are
    dealt out and added."""
    again = save(docs.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).select(key))
    if not again.limit(1).count():
        return _row_counts(docs, key, text, most, dominant)
    # A null key is one key too, which a join does not meet.
    same = again.select(F.col(key).alias("again"))
    meets = F.col(key).eqNullSafe(F.col("again"))
    added = _row_counts(docs.join(same, meets, "left_semi"), key, text, most).groupBy(key, "term").agg(F.sum("n").alias("n"))
    if dominant is not None:
        added = dominant_terms(added, key, dominant).drop("rank")
    return _row_counts(docs.join(same, meets, "left_anti"), key, text, most, dominant).union(added)


def _row_counts(docs: DataFrame, key: str, text: str, most: int, dominant: int | None = None) -> DataFrame:
    """(key, term, n) of each row."""
    kind = docs.schema[key].dataType

    def run(batches):
        from collections import Counter
        from heapq import nsmallest

        import pyarrow as pa

        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            at, terms, counts = [], [], []
            for i in range(batch.num_rows):
                w = lists[i].as_py()
                found = Counter(w)
                for n in range(2, most + 1):
                    found.update(map(" ".join, zip(*(w[k:] for k in range(n)), strict=False)))
                rows = found.items() if dominant is None else nsmallest(dominant, found.items(), key=lambda x: (-x[1], x[0]))
                at.extend([i] * len(rows))
                terms.extend(t for t, _ in rows)
                counts.extend(n for _, n in rows)
                if len(terms) >= ROWS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], [key, "term", "n"])
                    at, terms, counts = [], [], []

    words = docs.select(key, tokens(F.col(text)).alias("w"))
    return words.mapInArrow(run, StructType([StructField(key, kind), StructField("term", StringType()), StructField("n", LongType())]))


def zone_counts(pages: DataFrame, key: str = "url", zones: dict[str, int] | None = None) -> DataFrame:
    """(key, term, n, meta, heading): zone-weighted unigram counts and the zones a term occurs in."""
    zones = zones or ZONE_WEIGHTS
    def tagged(zone: str, weight: int):
        meta, heading = F.lit(zone in ("title", "description")), F.lit(zone == "headings")
        return F.transform(tokens(F.col(zone)), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w"), meta.alias("meta"), heading.alias("heading")))

    parts = [tagged(z, w) for z, w in zones.items()]
    rows = pages.select(key, F.explode(F.concat(*parts)).alias("t")).select(key, "t.*")
    return rows.groupBy(key, "term").agg(F.sum("w").alias("n"), F.max("meta").alias("meta"), F.max("heading").alias("heading"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))


def weights(counts: DataFrame, key: str, n_docs: Column) -> DataFrame:
    """Adds v = (1 + ln n)(1 + ln((1 + N) / (1 + df))).  ``counts`` has one row for each key and term."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    v = (1 + F.log(F.col("n"))) * (1 + F.log((1 + n_docs) / (1 + F.col("df"))))
    return counts.join(df, "term").withColumn("v", v)


def page_strengths(weighed: DataFrame, key: str) -> DataFrame:
    """(key, term, strength): weight as a percentage of the page's largest."""
    most = F.max("v").over(Window.partitionBy(key))
    return weighed.select(key, "term", tenths(F.col("v") / most).alias("strength"))


def site_weights(weighed: DataFrame, n_docs: Column) -> DataFrame:
    """(term, v, meta, heading) over the whole site: the mean weight."""
    zones = [F.max(c).alias(c) for c in ("meta", "heading") if c in weighed.columns]
    return weighed.groupBy("term").agg((F.sum("v") / n_docs).alias("v"), *zones)


def site_strengths(site: DataFrame) -> DataFrame:
    """Adds ``strength`` to ``site``; the maximum is one number."""
    most = site.agg(F.max("v").alias("most"))
    return site.crossJoin(F.broadcast(most)).withColumn("strength", tenths(F.col("v") / F.col("most"))).drop("most")


def top_terms(strengths: DataFrame, key: str | None = None, most: int = TOP_TERMS) -> DataFrame:
    """The ``most`` strongest terms of each key (or of all), by rounded strength and then term."""
    order = [F.desc("strength"), F.asc("term")]
    if key is None:
        return strengths.orderBy(*order).limit(most)
    return strengths.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def with_keywords(top: DataFrame, strengths: DataFrame, keywords: list[str]) -> DataFrame:
    """``top`` (site level) and, after it, the requested terms that it lacks, in request order; absent ones have 0."""
    spark = top.sparkSession
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(keywords)], "asked int, raw string").select("asked", F.array_join(tokens(F.col("raw")), " ").alias("term")).where("term <> ''")
    first = asked.groupBy("term").agg(F.min("asked").alias("asked"))
    more = first.join(strengths.select("term", "strength"), "term", "left").join(top.select("term"), "term", "left_anti")
    return top.select("term", "strength", F.lit(-1).alias("asked")).unionByName(more.select("term", F.coalesce("strength", F.lit(0.0)).alias("strength"), "asked")).orderBy("asked", F.desc("strength"), "term").limit(MAX_TERMS)


def weak_candidates(site: DataFrame) -> DataFrame:
    """Keyword-like terms with strength in (0, 50): (term, strength, tier, words); tier 0 meta, 1 heading, 2 other."""
    tier = F.when(F.col("meta"), 0).when(F.col("heading"), 1).otherwise(2)
    fit = site_strengths(site).where((F.col("strength") > 0) & (F.col("strength") < 50) & is_keyword(F.col("term")))
    return fit.select("term", "strength", tier.alias("tier"), (F.size(F.split("term", " "))).alias("words"))


def weak_terms(candidates: DataFrame, most: int = WEAK_TERMS) -> DataFrame:
    """The first candidates in order (tier, strength, words, term).  Terms are single words, so none shares one."""
    order = ["tier", "strength", "words", "term"]
    return candidates.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def common_terms(counts: DataFrame, n_docs: Column, share: float = SITE_SHARE, most: int = SITE_TOP) -> DataFrame:
    """Terms on at least ``share`` of the pages: (term, df, total, strength text)."""
    per = document_frequency(counts).withColumn("share", F.col("df") / n_docs).where(F.col("share") >= share)
    top = per.orderBy(F.desc("df"), F.desc("total"), "term").limit(most)
    return top.select("term", "df", "total", F.concat(F.format_string("%.1f", tenths(F.col("share"))), F.lit("%")).alias("strength"))


def dominant_terms(counts: DataFrame, key: str, most: int = DOMINANT) -> DataFrame:
    """The ``most`` commonest terms of each key, by count and then term, with their rank."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.asc("term"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def page_specific(counts: DataFrame, key: str, dominant: DataFrame | None = None) -> DataFrame:
    """(key, terms): dominant terms that no other page has, in rank order; ``dominant``: their counts, if they are known."""
    alone = document_frequency(counts).where("df <= 1").select("term")
    own = dominant_terms(counts if dominant is None else dominant, key).join(alone, "term", "left_semi")
    return own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("r")).select(key, F.col("r.term").alias("terms"))


def duplicate_profiles(counts: DataFrame, key: str) -> DataFrame:
    """(key, profile) of pages whose dominant terms equal those of a page with a smaller key."""
    signed = dominant_terms(counts, key).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"]), "|").alias("profile"))
    first = signed.groupBy("profile").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return signed.join(first.select("profile", "first"), "profile").where(F.col(key) > F.col("first")).select(key, "profile")
