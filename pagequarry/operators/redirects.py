"""Redirects followed over stored hops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normal_url
from ..storage import save

MAX_REDIRECTS = 10
STATUSES = (301, 302, 303, 307, 308)
STATE = ["url", "path", "at", "redirects"]


def resolve(starts: DataFrame, hops: DataFrame, most: int = MAX_REDIRECTS) -> DataFrame:
    """(url, final_url, status, redirects, path, error) for each of ``starts`` (url, in normal form).

    ``hops``: url, status, location, error: the answer to each request.  A redirect without a location is an answer like
    any other.  error: that of the answer, ``redirect loop``, ``too many redirects``, ``invalid redirect`` or ``not stored``.
    Each step is an equi-join of the walks that are still open, at most ``most`` + 2 of them."""
    answers = hops.select(F.col("url").alias("asked"), F.col("status").alias("status_"), F.coalesce("location", F.lit("")).alias("location_"), F.coalesce("error", F.lit("")).alias("error_")).dropDuplicates(["asked"])
    walks = starts.select("url", F.array().cast("array<string>").alias("path"), F.col("url").alias("at"), F.lit(0).alias("redirects"))
    none = F.lit(None).cast("int")
    done = []
    for _ in range(most + 2):
        seen = F.array_contains("path", F.col("at"))
        over = F.col("redirects") > most
        here = walks.withColumn("stop", F.when(over, "too many redirects").when(seen, "redirect loop"))
        done.append(here.where("stop is not null").select(*STATE, none.alias("status"), F.col("stop").alias("error")))
        met = save(here.where("stop is null").join(answers, F.col("at") == F.col("asked"), "left"))
        redirects = F.coalesce(F.col("status_").isin(*STATUSES) & (F.col("location_") != "") & (F.col("error_") == ""), F.lit(False))
        error = F.when(F.col("asked").isNull(), "not stored").otherwise(F.col("error_"))
        done.append(met.where(~redirects).select(*STATE, F.col("status_").alias("status"), error.alias("error")))
        moved = save(met.where(redirects).withColumn("next", normal_url(F.col("location_"), F.col("at"))))
        done.append(moved.where("next = ''").select("url", "path", "at", (F.col("redirects") + 1).alias("redirects"), F.col("status_").alias("status"), F.lit("invalid redirect").alias("error")))
        walks = moved.where("next <> ''").select("url", F.concat("path", F.array("at")).alias("path"), F.col("next").alias("at"), (F.col("redirects") + 1).alias("redirects"))
        if not walks.limit(1).count():
            break
    return reduce(DataFrame.union, done).select("url", F.col("at").alias("final_url"), "status", "redirects", "path", "error")
