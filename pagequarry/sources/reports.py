"""Saved reports: JSON of schema version 1, read into findings and summary, and written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"
FINDING = "struct<id:string,severity:string,category:string,url:string,title:string,evidence:array<string>,recommendation:string>"
SCHEMA = f"schema_version string, summary struct<start_url:string,pages:int,findings:map<string,int>,categories:array<string>,highest_severity:string,stop_reason:string,skipped:map<string,int>>, findings map<string,array<{FINDING}>>, scores struct<seo:int,web_hygiene:int>, created string"


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """One row; raises ValueError for another version or a file without findings."""
    report = spark.read.schema(SCHEMA).json(path, multiLine=True)
    first = report.select("schema_version", F.col("findings").isNotNull().alias("ok")).first()
    if first is None or first["schema_version"] != VERSION or not first["ok"]:
        raise ValueError("unsupported or invalid report")
    return report


def report_findings(report: DataFrame) -> DataFrame:
    """(grp, id, url, evidence, severity_name, category, title) of a loaded report."""
    rows = report.select(F.explode("findings").alias("grp", "fs")).select("grp", F.explode("fs").alias("f"))
    return rows.select("grp", "f.id", "f.url", F.coalesce("f.evidence", F.array().cast("array<string>")).alias("evidence"), F.col("f.severity").alias("severity_name"), "f.category", "f.title")


def report_json(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2) + "\n"
