"""Command line: audit a stored crawl, compare saved reports, print the version."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __version__
from .rules import SEVERITIES

FORMS = ("text", "detailed", "json", "html", "quick-wins")


def number(low: int, high: int):
    """A whole number from ``low`` to ``high``."""

    def whole(text: str) -> int:
        value = int(text)
        if not low <= value <= high:
            raise ValueError
        return value

    whole.__name__ = f"number from {low} to {high}"
    return whole


def start_address(text: str) -> str:
    """A start URL in normal form; https where no scheme is given."""
    from .functions.urls import BadUrl, normalize

    bare = text.strip()
    if not bare:
        raise BadUrl("invalid")
    return normalize(bare if "://" in bare else f"https://{bare}")


def overrides(given: list[str]) -> dict[str, str]:
    out = {}
    for text in given:
        rule, _, severity = text.partition("=")
        if severity not in SEVERITIES:
            raise ValueError(f"unknown severity in {text}")
        out[rule] = severity
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagequarry")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit", help="audit a crawl stored as Parquet")
    a.add_argument("corpus")
    a.add_argument("start_url")
    a.add_argument("--robots")
    a.add_argument("--sitemaps")
    a.add_argument("--keywords", default="")
    a.add_argument("--format", choices=FORMS, default="text")
    a.add_argument("--output")
    a.add_argument("--baseline")
    a.add_argument("--diff", action="store_true", help="only the changes since the baseline")
    a.add_argument("--fail-on", choices=list(SEVERITIES))
    a.add_argument("--other-fetches", help="fetch log of external links and of the start URL over http")
    a.add_argument("--max-pages", type=number(1, 1_000_000))
    a.add_argument("--max-depth", type=number(0, 1000))
    a.add_argument("--severity", action="append", default=[], metavar="RULE=SEVERITY", help="another severity for a rule")
    c = sub.add_parser("crawl", help="fetch a site and store it for audits: DIR/corpus, DIR/robots, DIR/sitemaps")
    c.add_argument("start_url")
    c.add_argument("output")
    c.add_argument("--max-pages", type=number(1, 1_000_000), default=500)
    c.add_argument("--max-depth", type=number(0, 1000), default=10)
    c.add_argument("--timeout", type=number(1, 3600), default=15, help="seconds for a fetch with its redirects")
    c.add_argument("--requests-per-second", type=number(1, 1000), default=5)
    c.add_argument("--user-agent", default="pagequarry")
    c.add_argument("--allow-private", action="store_true", help="loopback, private and link-local addresses too")
    d = sub.add_parser("diff", help="compare two saved reports")
    d.add_argument("baseline")
    d.add_argument("current")
    d.add_argument("--json", action="store_true")
    v = sub.add_parser("version")
    v.add_argument("--json", action="store_true")
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("pagequarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def diff_text(diff: dict) -> str:
    if not any(diff.values()):
        return "No changes since the baseline.\n"
    out = [f"Findings: {diff['finding_delta']:+d}"]
    for kind in ("new", "resolved"):
        out += [f"{len(diff[kind])} {kind}:"] + [f"  {f['id']} {f['url']}" for f in diff[kind]] if diff[kind] else []
    return "\n".join(out) + "\n"


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import functions as F

    from .functions.urls import BadUrl
    from .operators.findings import with_severity
    from .plans import report as reports
    from .plans.audit import audit
    from .plans.stored_crawl import crawl_corpus
    from .sources.reports import load_report, report_findings

    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return reports.EXIT_USAGE if e.code else reports.EXIT_OK
    if args.command == "version":
        print(json.dumps({"version": __version__}) if args.json else __version__)
        return reports.EXIT_OK
    spark = session()
    if args.command == "crawl":
        from .plans.live_crawl import live_crawl
        from .sources.fetch import Limits

        try:
            start = start_address(args.start_url)
        except BadUrl as e:
            print(f"invalid argument: {e}", file=sys.stderr)
            return reports.EXIT_USAGE
        done = live_crawl(spark, start, args.max_pages, args.max_depth, Limits(timeout=args.timeout, per_second=args.requests_per_second, agent=args.user_agent, allow_private=args.allow_private))
        for name, table in (("corpus", done.corpus), ("robots", done.robots_files), ("sitemaps", done.sitemap_files)):
            table.write.parquet(f"{args.output}/{name}")
        print(f"{done.corpus.count()} pages stored; stopped: {done.stop_reason}")
        failed = done.stop_reason == "start-disallowed" or done.corpus.where((F.col("url") == start) & (F.col("error") != "")).limit(1).count() > 0
        return reports.exit_code({"summary": {"highest_severity": ""}}, None, failed)
    if args.command == "diff":
        loaded = [report_findings(load_report(spark, p)) for p in (args.current, args.baseline)]
        diff = reports.compare(*loaded)
        print(json.dumps(diff, ensure_ascii=False) if args.json else diff_text(diff), end="\n" if args.json else "")
        return reports.EXIT_OK
    try:
        start, severities = start_address(args.start_url), overrides(args.severity)
    except (BadUrl, ValueError) as e:
        print(f"invalid argument: {e}", file=sys.stderr)
        return reports.EXIT_USAGE
    if args.diff and not args.baseline:
        print("--diff needs --baseline", file=sys.stderr)
        return reports.EXIT_USAGE
    read = lambda p: spark.read.parquet(p) if p else None
    corpus, robots_files = read(args.corpus), read(args.robots)
    reason, skipped = "completed", {}
    if args.max_pages is not None or args.max_depth is not None:
        limits = {k: v for k, v in (("max_pages", args.max_pages), ("max_depth", args.max_depth)) if v is not None}
        crawled = crawl_corpus(corpus, start, robots_files=robots_files, **limits)
        corpus, reason, skipped = crawled.corpus, crawled.stop_reason, crawled.skip_counts()
    result = audit(corpus, start, [k.strip() for k in args.keywords.split(",") if k.strip()], robots_files, read(args.sitemaps), read(args.other_fetches))
    if severities:
        result.findings = with_severity(result.findings, severities)
    report = reports.build_report(result, start, reason, skipped)
    text = reports.render(report, args.format)
    if args.baseline:
        changes = diff_text(reports.compare(result.findings, report_findings(load_report(spark, args.baseline))))
        text = changes if args.diff else text + changes
    if args.output:
        path = Path(args.output)
        path.touch(mode=0o600)
        path.write_text(text)
    else:
        sys.stdout.write(text)
    failed = corpus.where((F.col("url") == start) & (F.coalesce("error", F.lit("")) != "")).limit(1).count() > 0
    return reports.exit_code(report, args.fail_on, failed or reason == "start-disallowed")


if __name__ == "__main__":
    sys.exit(main())
