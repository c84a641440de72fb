"""Findings: building, limiting, ordering, counting, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shortened
from ..rules import GROUPS, PENALTIES, SEVERITIES, rules_table

MAX_EVIDENCE, MAX_EVIDENCE_CHARS, QUICK_WINS = 20, 300, 8
FINDING = "array<struct<grp:string,id:string,url:string,evidence:array<string>>>"


def lines(*parts) -> Column:
    """Evidence from columns or strings."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.array(*cols).cast("array<string>") if cols else F.array().cast("array<string>")


def limited(evidence: Column, total: Column | None = None) -> Column:
    """At most MAX_EVIDENCE lines of MAX_EVIDENCE_CHARS, and how many more there are (of ``total``)."""
    short = F.transform(F.slice(evidence, 1, MAX_EVIDENCE), lambda x: shortened(x, MAX_EVIDENCE_CHARS))
    more = (F.size(evidence) if total is None else total) - MAX_EVIDENCE
    return F.when(more > 0, F.concat(short, F.array(F.concat(F.lit("... and "), more.cast("string"), F.lit(" more"))))).otherwise(short)


def finding(group: str, rule: str, url: Column, evidence: Column | None = None, when: Column | None = None, total: Column | None = None) -> Column:
    """A finding struct, null unless ``when``."""
    body = F.struct(F.lit(group).alias("grp"), F.lit(rule).alias("id"), url.alias("url"), limited(evidence if evidence is not None else lines(), total).alias("evidence"))
    return body if when is None else F.when(when, body)


def spread(rows: DataFrame, *candidates: Column, many: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each finding among ``candidates`` (structs or null) and ``many`` (an array of structs)."""
    array = F.array(*candidates) if candidates else None
    array = many if array is None else array if many is None else F.concat(array, many)
    one = rows.select(*keep, F.explode(F.filter(array, lambda f: f.isNotNull())).alias("f"))
    return one.select(*keep, "f.grp", "f.id", "f.url", "f.evidence")


def with_rules(found: DataFrame) -> DataFrame:
    """Adds severity, severity_name, category, title, advice; the dimension has 109 rows."""
    return found.join(F.broadcast(rules_table(found.sparkSession)), "id")


def report_order(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("severity"), "id", "url", "evidence")


def at_least(found: DataFrame, severity: str) -> DataFrame:
    return found.where(F.col("severity") >= SEVERITIES[severity])


def with_severity(found: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """``found`` (as of ``with_rules``) with other severities for some rules."""
    name = F.coalesce(*[F.when(F.col("id") == rule, severity) for rule, severity in overrides.items()], F.col("severity_name"))
    rank = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    return found.withColumn("severity_name", name).withColumn("severity", rank[F.col("severity_name")].cast("int"))


def worst_by_group(found: DataFrame) -> DataFrame:
    """(grp, n, severity, severity_name): each group's number of findings and worst severity."""
    worst = found.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("severity", "severity_name")).alias("w"))
    return worst.select("grp", "n", "w.severity", "w.severity_name")


def severity_counts(found: DataFrame) -> DataFrame:
    """(severity_name, n) of all five levels."""
    spark = found.sparkSession
    levels = spark.createDataFrame([(s, k) for s, k in SEVERITIES.items()], "severity_name string, severity int")
    n = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(levels).join(n, "severity", "left").select("severity_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def penalty(severity_name: Column) -> Column:
    return F.coalesce(*[F.when(severity_name == s, w) for s, w in PENALTIES.items()])


def scores(found: DataFrame, indexable_pages: Column | int) -> DataFrame:
    """One row (seo, web_hygiene): 100 less the penalty sum by page, in whole numbers, not below 0; null without pages."""
    n = F.lit(indexable_pages) if isinstance(indexable_pages, int) else indexable_pages
    part = lambda own: F.coalesce(F.sum(F.when(own, penalty(F.col("severity_name"))).otherwise(0)), F.lit(0))
    sums = found.agg(part(F.col("grp") != "web-hygiene").alias("other"), part(F.col("grp") == "web-hygiene").alias("hygiene"))
    score = lambda c: F.when(n > 0, F.greatest(F.lit(0), 100 - F.floor(F.col(c) / n))).cast("int")
    return sums.select(score("other").alias("seo"), score("hygiene").alias("web_hygiene"))


def group_order(group: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GROUPS]), group)


def quick_wins(found: DataFrame, most: int = QUICK_WINS) -> DataFrame:
    """The first finding of each rule of at least medium weight first, by severity, group and report order."""
    order = [F.desc("severity"), group_order(F.col("grp")).asc(), F.asc("id"), F.asc("url"), F.asc("evidence")]
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("k = 1").drop("k")
    return first.orderBy(*order).limit(most)


def finding_key(found: DataFrame) -> Column:
    return F.concat_ws("\x00", F.concat(F.array(F.col("id"), F.col("url")), F.col("evidence")))


def changed(current: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, resolved) findings by key: id, url and evidence; a key counts once."""
    now = current.withColumn("key", finding_key(current)).dropDuplicates(["key"])
    then = baseline.withColumn("key", finding_key(baseline)).dropDuplicates(["key"])
    return now.join(then.select("key"), "key", "left_anti").drop("key"), then.join(now.select("key"), "key", "left_anti").drop("key")


def group_changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(grp, change): groups that only one report has."""
    now, then = current.select("grp").distinct(), baseline.select("grp").distinct()
    added = now.exceptAll(then).select("grp", F.lit("added").alias("change"))
    return added.union(then.exceptAll(now).select("grp", F.lit("removed").alias("change")))
