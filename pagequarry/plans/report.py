"""Reports of an audit: summary, text, JSON, HTML, and comparison."""

from __future__ import annotations

import html
from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..functions.text import printable
from ..operators.findings import changed, group_changes, quick_wins, report_order, severity_counts
from ..rules import CATEGORIES, GROUPS, SEVERITIES
from ..sources.reports import VERSION, report_json
from .audit import Audit

EXIT_OK, EXIT_FINDINGS, EXIT_USAGE, EXIT_START, EXIT_INTERRUPTED, EXIT_INTERNAL = 0, 1, 2, 3, 4, 5
FEW, MANY = 3, 20


def build_report(result: Audit, start_url: str, stop_reason: str = "completed", skipped: dict[str, int] | None = None) -> dict:
    """The report as a document; a site's findings are collected, so this is for one site."""
    rows = [r.asDict(recursive=True) for r in report_order(result.findings).collect()]
    groups = {g: [] for g in GROUPS}
    for r in rows:
        groups[r["grp"]].append({"id": r["id"], "severity": r["severity_name"], "category": r["category"], "url": r["url"], "title": r["title"], "evidence": r["evidence"], "recommendation": r["advice"]})
    score = result.scores.first()
    highest = max((r["severity"] for r in rows), default=0)
    return {
        "schema_version": VERSION,
        "created": datetime.now(UTC).isoformat(timespec="seconds"),
        "summary": {"start_url": start_url, "pages": result.pages.count(), "findings": {r["severity_name"]: r["n"] for r in severity_counts(result.findings).collect()}, "categories": [g for g in GROUPS if groups[g]], "highest_severity": next((s for s, k in SEVERITIES.items() if k == highest), ""), "stop_reason": stop_reason, "skipped": skipped or {}},
        "findings": {g: fs for g, fs in groups.items() if fs},
        "scores": None if score["seo"] is None else {"seo": score["seo"], "web_hygiene": score["web_hygiene"]},
        "terms": [r.asDict() for r in result.terms.collect()],
        "weak_terms": [{"term": r["term"], "strength": r["strength"]} for r in result.weak_terms.collect()],
        "pages": [r.asDict() for r in result.metrics.orderBy("url").collect()],
        "crawl_delay_seconds": {r["url"]: r["seconds"] for r in result.crawl_delays.collect()} if result.crawl_delays is not None else {},  # one robots.txt for each origin
        "quick_wins": [r["id"] for r in quick_wins(result.findings).collect()],
    }


def store(result: Audit, folder: str) -> None:
    """The audit's frames as Parquet below ``folder``: the form for corpora whose findings no report document can hold."""
    for name in ("findings", "metrics", "terms", "weak_terms", "scores"):
        getattr(result, name).write.parquet(f"{folder}/{name}")


def highlights(report: dict) -> tuple[list[str], list[str]]:
    """(strengths, weaknesses) in words."""
    good, bad = [], []
    for name, label in (("seo", "technical SEO"), ("web_hygiene", "web hygiene")):
        if report["scores"]:
            value = report["scores"][name]
            (good if value >= 80 else bad).append(f"{label} score {value}/100")
    pages = report["pages"]
    indexable = [p for p in pages if p["indexable"]]
    if pages:
        (good if indexable else bad).append(f"{len(indexable)} of {len(pages)} pages are indexable")
    most = max(indexable, key=lambda p: (p["inbound"], p["url"]), default=None)
    if most and most["inbound"]:
        good.append(f"most linked page: {most['url']} ({most['inbound']} inbound links)")
    lone = [p for p in indexable[1:] if not p["inbound"] and p["url"] != report["summary"]["start_url"]]
    if lone:
        bad.append(f"{len(lone)} indexable pages have no inbound links")
    n = report["summary"]["findings"]
    serious = n["critical"] + n["high"]
    (bad if serious else good).append(f"{n['critical']} critical and {n['high']} high findings" if serious else "no critical or high findings")
    clean = [CATEGORIES[g] for g in GROUPS if not report["findings"].get(g)]
    if clean and pages:
        good.append("clean categories: " + ", ".join(clean))
    keywords = [t for t in report["terms"] if t["strength"] > 0]
    if keywords:
        good.append("strongest terms: " + ", ".join(f"{t['term']} ({t['strength']:.1f})" for t in keywords[:5]))
    absent = [t["term"] for t in report["terms"] if t["strength"] <= 0]
    if absent:
        bad.append("missing keywords: " + ", ".join(absent))
    return good, bad


def _clean(text: str) -> str:
    return "".join(c for c in text if c in "\n\t" or c.isprintable())


def render_text(report: dict, detailed: bool = False) -> str:
    s = report["summary"]
    out = [f"Audit of {s['start_url']}: {s['pages']} pages, " + ", ".join(f"{n} {name}" for name, n in s["findings"].items() if n)]
    if report["scores"]:
        out.append(f"Scores: SEO {report['scores']['seo']}, web hygiene {report['scores']['web_hygiene']}")
    if s["stop_reason"] != "completed" or s["skipped"]:
        out.append(f"Crawl stopped: {s['stop_reason']}" + "".join(f"; {n} {reason}" for reason, n in skipped_rows(report)))
    out += [f"robots.txt at {url} asks for {seconds:g} seconds between requests" for url, seconds in sorted(report.get("crawl_delay_seconds", {}).items())]
    for title, lines in zip(("Strengths", "Weaknesses"), highlights(report), strict=True):
        out += [f"{title}:"] + [f"  {x}" for x in lines] if lines else []
    for group in GROUPS:
        shown = {True: 0, False: 0}
        fs = report["findings"].get(group, [])
        if fs:
            out.append(f"\n{CATEGORIES[group]} ({len(fs)}, worst: {worst_of(fs)})")
        for f in fs:
            weighty = SEVERITIES[f["severity"]] >= SEVERITIES["medium"]
            shown[weighty] += 1
            if detailed or shown[weighty] <= (MANY if weighty else FEW):
                out.append(f"  [{f['severity']}] {f['id']} {f['title']}" + (f" ({f['url']})" if f["url"] else ""))
                out += [f"      {e}" for e in f["evidence"]] if detailed else []
        hidden = sum(max(0, n - (MANY if w else FEW)) for w, n in shown.items())
        if hidden and not detailed:
            out.append(f"  ... and {hidden} more")
    return _clean("\n".join(out)) + "\n"


def instruction(f: dict) -> str:
    """What to do about one finding, in words that can be handed on: to whoever edits the page, or, for findings of no
    single page, the site's templates and settings."""
    told = "".join(f"\n- {line}" for line in f["evidence"])
    place = f"Change the page {f['url']}" if f["url"] else "Change the site's templates or settings, not single pages"
    return f"{place}: {f['recommendation']} Reason: {f['title']} ({f['id']}, {f['severity']}, {f['category']})." + (f" Seen:{told}" if told else "")


def skipped_rows(report: dict) -> list[tuple[str, int]]:
    """(reason, URLs) in order of reason."""
    return sorted(report["summary"]["skipped"].items())


def severity_sections(report: dict) -> list[tuple[str, list[dict]]]:
    """Severities from the worst, those without findings left out, with their findings in order of group."""
    every = [f for g in GROUPS for f in report["findings"].get(g, [])]
    order = sorted(SEVERITIES, key=SEVERITIES.get, reverse=True)
    return [(s, own) for s in order if (own := [f for f in every if f["severity"] == s])]


def worst_of(findings_: list[dict]) -> str:
    return max((f["severity"] for f in findings_), key=SEVERITIES.get, default="")


def render_html(report: dict, wins_only: bool = False) -> str:
    e = html.escape
    item = lambda f: f"<li class='{e(f['severity'])}'><b>{e(f['id'])}</b> {e(_clean(f['title']))} <code>{e(_clean(f['url']))}</code><pre>{e(_clean(instruction(f)))}</pre></li>"
    sections = [(s, [f for f in fs if not wins_only or f["id"] in report["quick_wins"]]) for s, fs in severity_sections(report)]
    body = "".join(f"<section id='{e(s)}'><h3>{e(s)} ({len(fs)})</h3><ol>{''.join(map(item, fs))}</ol></section>" for s, fs in sections if fs)
    groups = "".join(f"<tr><td>{e(CATEGORIES[g])}</td><td>{len(fs)}</td><td>{e(worst_of(fs))}</td></tr>" for g in GROUPS if (fs := report["findings"].get(g)))
    skipped = "".join(f"<tr><td>{e(reason)}</td><td>{n}</td></tr>" for reason, n in skipped_rows(report))
    good, bad = highlights(report)
    listed = lambda xs: "<ul>" + "".join(f"<li>{e(_clean(x))}</li>" for x in xs) + "</ul>"
    return f"<!doctype html><meta charset='utf-8'><title>Audit</title><h1>{e(report['summary']['start_url'])}</h1><h2>Strengths</h2>{listed(good)}<h2>Weaknesses</h2>{listed(bad)}<h2>Groups</h2><table>{groups}</table><h2>Findings</h2>{body}<h2>Not fetched</h2><p>Stopped: {e(report['summary']['stop_reason'])}</p><table>{skipped}</table>\n"


def render(report: dict, form: str = "text") -> str:
    """text, detailed, json, html or quick-wins."""
    forms = {"text": render_text, "detailed": lambda r: render_text(r, True), "json": report_json, "html": render_html, "quick-wins": lambda r: render_html(r, True)}
    if form not in forms:
        raise ValueError(f"unknown format {form}")
    return forms[form](report)


def compare(current, baseline, current_report: dict | None = None, baseline_report: dict | None = None) -> dict:
    """New and resolved findings, group changes and deltas; frames as of ``with_rules`` or of a loaded report."""
    new, resolved = changed(current, baseline)
    rows = lambda df: [r.asDict(recursive=True) for r in df.select("grp", "id", "url", "evidence").orderBy("id", "url", "evidence").collect()]
    groups = group_changes(current, baseline).collect()
    out = {"new": rows(new), "resolved": rows(resolved), "added_groups": sorted(r["grp"] for r in groups if r["change"] == "added"), "removed_groups": sorted(r["grp"] for r in groups if r["change"] == "removed"), "finding_delta": current.count() - baseline.count()}
    if current_report and baseline_report:
        out["page_delta"] = current_report["summary"]["pages"] - baseline_report["summary"]["pages"]
        both = current_report["scores"] and baseline_report["scores"]
        for k in ("seo", "web_hygiene"):
            out[f"{k}_delta"] = current_report["scores"][k] - baseline_report["scores"][k] if both else 0
    return out


def is_unchanged(diff: dict) -> bool:
    return not any(diff.values())


def exit_code(report: dict, fail_on: str | None = None, start_failed: bool = False) -> int:
    if start_failed:
        return EXIT_START
    worst = SEVERITIES.get(report["summary"]["highest_severity"], 0)
    return EXIT_FINDINGS if fail_on and worst >= SEVERITIES[fail_on] else EXIT_OK


def evidence_lines(found):
    """(id, url, line): evidence as printable text."""
    return found.select("id", "url", F.explode("evidence").alias("line")).withColumn("line", printable(F.col("line")))
