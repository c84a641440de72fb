"""Which URLs robots.txt lets an agent fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import finding, lines, spread

AGENTS = ("*", "googlebot", "bingbot")
MAX_BYTES = 500 << 10


def agent_token(name: Column) -> Column:
    return F.regexp_extract(name, r"^[^/ \t]*", 0)


def crawl_delay(agents: Column, delays: Column, agent: str) -> Column:
    """Seconds that robots.txt asks ``agent`` to wait: of the groups that name it, else of ``*``; null where none says so.
    It is reported, not kept: requests are spaced by the crawler's own limit."""
    named = F.exists(agents, lambda a: agent_token(a) == agent)
    of = lambda d: F.exists(d["agents"], lambda a: F.when(named, agent_token(a) == agent).otherwise(a == "*"))
    return F.get(F.filter(delays, of), F.lit(0))["seconds"]


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a Java regex for the start of a path: * any run, a final $ the end.  Runs of * are one, and
    the runs are lazy, so a match needs no backtracking into what a later literal settled."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"\*+", "*")
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(quoted, r"\*", ".*?"), F.when(pattern.endswith("$"), r"\z").otherwise(""))


def rules_for(rules: DataFrame, agents: DataFrame) -> DataFrame:
    """(origin, asked, allow, pattern, line): the rules of the groups that name the asked agent's token, else of ``*``.

    ``rules``: origin, agent, allow, pattern, line, a row for each agent of a group, pattern null where a group has no
    rule; ``agents``: origin, asked."""
    asked = agents.select("origin", F.lower("asked").alias("asked")).distinct()
    keyed = rules.withColumn("token", F.when(F.col("agent") != "*", agent_token(F.col("agent"))))
    own = keyed.join(asked.withColumnRenamed("asked", "token").where("token <> '*'"), ["origin", "token"]).withColumn("asked", F.col("token"))
    has = own.select("origin", "asked").distinct()
    rest = rules.where("agent = '*'").join(asked.join(has, ["origin", "asked"], "left_anti"), "origin")
    return own.select("origin", "asked", "allow", "pattern", "line").unionByName(rest.select("origin", "asked", "allow", "pattern", "line")).where("pattern is not null")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (origin, asked, path) with ``allowed`` and the deciding ``pattern`` and ``line`` (null: none).

    The longest pattern that fits decides, an allow before a disallow; /robots.txt is always allowed.  An equi-join on
    origin and agent, then the patterns; a path meets only its own origin's rules."""
    shaped = rules.withColumn("regex", pattern_regex(F.col("pattern")))
    paths = urls.withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path"))).select("origin", "asked", "path").distinct()
    fits = paths.join(shaped, ["origin", "asked"]).where(F.expr("rlike(path, regex)") & (F.col("path") != "/robots.txt"))
    rank = F.struct(F.octet_length("pattern"), F.col("allow"), -F.col("line"))
    best = fits.groupBy("origin", "asked", "path").agg(F.max_by(F.struct("allow", "pattern", "line"), rank).alias("b"))
    joined = urls.withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path"))).join(best, ["origin", "asked", "path"], "left")
    return joined.select(*urls.columns, F.coalesce("b.allow", F.lit(True)).alias("allowed"), F.col("b.pattern").alias("pattern"), F.col("b.line").alias("line"))


def outcome(status: Column, error: Column, blocked: Column | None = None) -> Column:
    """ok, not-found, unavailable or blocked."""
    hit = F.when(blocked, "blocked") if blocked is not None else F.when(F.lit(False), "blocked")
    return hit.when(F.coalesce(error, F.lit("")) != "", "unavailable").when(status.between(200, 299), "ok").when(status.between(400, 499), "not-found").otherwise("unavailable")


def robots_findings(files: DataFrame, start_checks: DataFrame, product: str) -> DataFrame:
    """``files``: url, final_url, status, error, outcome, size and the parsed fields; ``start_checks``: ``allowed`` rows of
    the start URL (column start) for AGENTS and the product, with origin = files.url."""
    url = F.col("url")
    own = lambda rule, when, ev=None: finding("crawlability", rule, url, ev, when)
    ok = F.col("outcome") == "ok"
    down = F.array_compact(F.array(F.concat(F.lit("outcome: "), F.col("outcome")), F.when(F.col("status") > 0, F.concat(F.lit("HTTP status "), F.col("status").cast("string"))), F.col("error")))
    told = F.transform("warnings", lambda w: F.concat(F.lit("line "), w["line"].cast("string"), F.lit(": "), w["message"]))
    bad = F.transform(F.filter("sitemaps", lambda s: ~s["url"].rlike(r"^(?i)https?://")), lambda s: F.concat(F.lit("line "), s["line"].cast("string"), F.lit(": "), s["url"]))
    first = spread(
        files,
        own("SEO-ROBOTS-001", F.col("outcome") == "not-found", lines(F.concat(F.lit("HTTP status "), F.col("status").cast("string")))),
        own("SEO-ROBOTS-002", F.col("outcome").isin("unavailable", "blocked"), down),
        own("SEO-ROBOTS-005", ok & (F.size("warnings") > 0), told),
        own("SEO-ROBOTS-006", ok & (F.size("sitemaps") == 0)),
        own("SEO-ROBOTS-007", ok & (F.size(bad) > 0), bad),
        own("SEO-ROBOTS-008", ok & ((F.col("size") > MAX_BYTES) | F.col("truncated")), lines(F.format_string("size %d bytes, %d rules", F.col("size"), F.size("rules")))),
        own("SEO-ROBOTS-009", ok & (F.btrim(F.coalesce("final_url", F.lit(""))) != "") & (F.col("final_url") != url), lines(F.concat(F.lit("final URL: "), F.col("final_url")))),
    )
    place = F.array_position(F.array(*map(F.lit, AGENTS)), F.col("asked"))
    blocked = start_checks.where("not allowed").groupBy("origin", "start").agg(F.min_by(F.struct("asked", "pattern", "line"), F.when(place > 0, place)).alias("b"), F.max(F.struct(F.col("asked") == product, "pattern", "line")).alias("p"))
    general = F.format_string("user-agent %s: line %d: Disallow: %s", F.col("b.asked"), F.col("b.line"), F.col("b.pattern"))
    mine = F.format_string("line %d: Disallow: %s", F.col("p.line"), F.col("p.pattern"))
    hit = F.col("b").isNotNull()
    second = spread(blocked, finding("crawlability", "SEO-ROBOTS-003", F.col("start"), lines(general), hit), finding("crawlability", "SEO-ROBOTS-004", F.col("start"), lines(mine), ~hit & F.col("p.col1")))
    return first.union(second)
