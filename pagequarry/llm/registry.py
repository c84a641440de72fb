"""The subpackage's queries: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, linededup, mixing, quality, sharding, simhash, toxicity, urlfilter, warczip
from .storage import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark, sf_dir):
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "n_bytes", F.exp("log_perplexity").alias("perplexity"), F.exp("threshold").alias("threshold"), "keep")


def op4_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark, sf_dir):
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark, sf_dir):
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op7_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    placed = plan.withColumn("position", F.get("positions", F.lit(0))).withColumn("second_position", F.get("positions", F.lit(1)))
    return mixing.by_position(placed).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"), F.round("second_position", 6).alias("second_position"))


def op9_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    read = warczip.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_fingerprints, op2_decontamination, op3_quality, op4_toxicity, op5_url_filter, op6_line_dedup, op7_simhash, op8_mixing, op9_sharding, op10_warc)}
