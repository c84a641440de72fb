"""Checks of structured data, as expressions over the facts of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.structured import GENERAL, RECOMMENDED, REQUIRED
from .findings import finding, spread


def is_url_text(text: Column) -> Column:
    """An http(s) URL with a host, or a reference without white space."""
    bare = F.btrim(text)
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.when(bare == "", False).when(scheme == "", ~bare.rlike(r"[ \t\n]") & ~bare.rlike(r"^//[/?#]")).otherwise(bare.rlike(r"^(?i:https?)://[^/?#]"))


# ---------------------------------------------------------------- properties


def _rules() -> Column:
    """general type -> rules (names of which one is enough, required); a table of fixed size, as a map."""
    pairs = []
    for general in sorted({*REQUIRED, *RECOMMENDED}):
        rules = [(group.split("|"), True) for group in REQUIRED.get(general, [])] + [([name], False) for name in RECOMMENDED.get(general, "").split()]
        pairs += [F.lit(general), F.array(*[F.struct(F.array(*map(F.lit, names)).alias("names"), F.lit(needed).alias("required")) for names, needed in rules])]
    return F.create_map(*pairs)


def gaps(types: Column, filled: Column, top: Column) -> Column:
    """Rules that an item does not meet: array of (type, names, required).  Each general type counts once, by the first
    of the item's types that stands for it; recommended properties are asked of top-level items."""
    general = F.create_map(*[F.lit(x) for pair in GENERAL.items() for x in pair])
    known = F.filter(F.transform(types, lambda t: F.struct(t.alias("type"), general[t].alias("general"))), lambda x: x["general"].isNotNull())
    generals = F.transform(known, lambda x: x["general"])
    first = F.filter(known, lambda x, i: F.array_position(generals, x["general"]) == i + 1)
    unmet = lambda rule: ~F.arrays_overlap(rule["names"], filled) & (rule["required"] | top)
    found = F.transform(first, lambda x: F.transform(F.filter(F.coalesce(_rules()[x["general"]], F.array().cast("array<struct<names:array<string>,required:boolean>>")), unmet), lambda rule: F.struct(x["type"].alias("type"), rule["names"].alias("names"), rule["required"].alias("required"))))
    return F.flatten(found)


def _place(item: Column) -> Column:
    return F.concat(F.lit("block "), item["block"].cast("string"), F.lit(" "), item["path"])


def property_lines(items: Column) -> tuple[Column, Column, Column]:
    """Evidence lines (required, recommended, bad URLs) of an array of items."""

    def told(item: Column, gap: Column) -> Column:
        return F.concat(_place(item), F.lit(" ("), gap["type"], F.lit("): missing "), F.array_join(gap["names"], " or "))

    def lines_of(required: bool) -> Column:
        of = lambda item: F.transform(F.filter(gaps(item["types"], item["filled"], item["top"]), lambda g: g["required"] == required), lambda g: told(item, g))
        return F.flatten(F.transform(items, of))

    def asked(item: Column) -> Column:
        numbered = F.transform(item["faq"], lambda q, i: F.struct(q["question"].alias("question"), q["named"].alias("named"), q["answered"].alias("answered"), i.alias("at")))
        lead = lambda q: F.concat(_place(item), F.lit(" mainEntity["), q["at"].cast("string"), F.lit("]: "))
        lacks = lambda q: F.array_compact(F.array(F.when(~q["question"], "no Question"), F.when(q["question"] & ~q["named"], "no name"), F.when(q["question"] & ~q["answered"], "no text of acceptedAnswer")))
        return F.flatten(F.transform(numbered, lambda q: F.transform(lacks(q), lambda what: F.concat(lead(q), what))))

    bad = F.flatten(F.transform(items, lambda item: F.transform(F.filter(item["links"], lambda x: ~is_url_text(x["text"])), lambda x: F.concat(_place(item), F.lit("."), x["property"], F.lit(": "), F.substring(x["text"], 1, 120)))))
    return F.concat(lines_of(True), F.flatten(F.transform(items, asked))), lines_of(False), bad


# ---------------------------------------------------------------- breadcrumbs


def whole(position: Column) -> Column:
    """A whole number from 1, or null."""
    return F.when(position.rlike(r"^[+]?0*[1-9][0-9]{0,8}$"), position.cast("int"))


def repeats(entries: Column) -> Column:
    """Entries whose position or target an earlier entry has: array of (what, value, first, at), numbered from 1."""

    def of(what: str, values: Column) -> Column:
        numbered = F.transform(values, lambda v, i: F.struct(F.lit(what).alias("what"), v.alias("value"), F.array_position(values, v).cast("int").alias("first"), (i + 1).alias("at")))
        return F.filter(numbered, lambda x: x["value"].isNotNull() & (x["first"] < x["at"]))

    places = F.transform(entries, lambda e: whole(e["position"]).cast("string"))
    targets = F.transform(entries, lambda e: F.when(e["item"] != "", e["item"]))
    return F.concat(of("position", places), of("target", targets))


def first_gap(entries: Column) -> Column:
    """The least number from 1 to the number of entries that no entry has as its position; null where some entry
    repeats or lacks a position."""
    places = F.transform(entries, lambda e: whole(e["position"]))
    numbers = F.when(F.size(entries) > 0, F.sequence(F.lit(1), F.size(entries)))
    clean = (F.size(repeats(entries)) == 0) & F.forall(places, lambda p: p.isNotNull())
    return F.when(clean, F.array_min(F.array_except(numbers, places)))


def entry_faults(entries: Column) -> Column:
    """(at, fault) of entries without name, position or target (the last needs none), or with a target that is no URL."""
    size = F.size(entries)

    def of(e: Column, i: Column) -> Column:
        n = i + 1
        fault = lambda text, when: F.when(when, F.struct(n.alias("at"), text.alias("fault")))
        no_target = e["item"] == ""
        return F.array_compact(
            F.array(
                fault(F.concat(F.lit('position "'), e["position"], F.lit('" is no whole number from 1')), whole(e["position"]).isNull()),
                fault(F.lit("no name"), e["name"] == ""),
                fault(F.lit("no target"), no_target & (n < size)),
                fault(F.concat(F.lit('target "'), F.substring(e["item"], 1, 120), F.lit('" is no URL')), ~no_target & ~is_url_text(e["item"])),
            )
        )

    return F.flatten(F.transform(entries, of))


def crumb_lines(crumbs: Column) -> tuple[Column, Column, Column]:
    """Evidence lines (malformed lists, invalid entries, repeats) of an array of breadcrumb lists."""
    lead = lambda c: F.concat(c["source"], F.lit(" "), c["place"], F.lit(": "))
    good = lambda c: F.filter(c["entries"], lambda e: e["kind"] == "entry")
    number = lambda x: x.cast("string")

    def malformed(c: Column) -> Column:
        state = F.when(c["given"] == "absent", "no itemListElement").when(c["given"] == "other", "itemListElement is no list").when(F.size(c["entries"]) == 0, "itemListElement is empty")
        odd = F.filter(F.transform(c["entries"], lambda e, i: F.when(e["kind"] != "entry", F.concat(F.lit("element "), number(i + 1), F.when(e["kind"] == "object", " is no ListItem").otherwise(" is no object")))), lambda x: x.isNotNull())
        return F.transform(F.concat(F.array_compact(F.array(state)), odd), lambda x: F.concat(lead(c), x))

    def faults(c: Column) -> Column:
        gap = first_gap(good(c))
        own = F.transform(entry_faults(good(c)), lambda x: F.concat(F.lit("entry "), number(x["at"]), F.lit(": "), x["fault"]))
        return F.transform(F.concat(own, F.array_compact(F.array(F.when(gap.isNotNull(), F.concat(F.lit("positions leave out "), number(gap)))))), lambda x: F.concat(lead(c), x))

    def doubled(c: Column) -> Column:
        return F.transform(repeats(good(c)), lambda x: F.concat(lead(c), x["what"], F.lit(" "), x["value"], F.lit(" in entries "), number(x["first"]), F.lit(" and "), number(x["at"])))

    return tuple(F.flatten(F.transform(crumbs, of)) for of in (malformed, faults, doubled))


def structured_findings(pages: DataFrame) -> DataFrame:
    """``pages``: url, schema_items, crumbs and the lines of blocks that could not be read."""
    required, recommended, bad = property_lines(F.col("schema_items"))
    malformed, faults, doubled = crumb_lines(F.col("crumbs"))
    told = pages.select("url", "schema_errors", "schema_untyped", "schema_context", "schema_truncated", required.alias("required"), recommended.alias("recommended"), bad.alias("bad"), malformed.alias("malformed"), faults.alias("faults"), doubled.alias("doubled"))
    rules = {"SEO-SCHEMA-001": "schema_errors", "SEO-SCHEMA-002": "schema_untyped", "SEO-SCHEMA-003": "schema_context", "SEO-SCHEMA-004": "required", "SEO-SCHEMA-005": "recommended", "SEO-SCHEMA-006": "bad", "SEO-BREADCRUMB-001": "malformed", "SEO-BREADCRUMB-002": "faults", "SEO-BREADCRUMB-003": "doubled"}
    found = [finding("structured-data", rule, F.col("url"), F.col(field), F.size(field) > 0) for rule, field in rules.items()]
    return spread(told, *found, finding("structured-data", "SEO-SCHEMA-007", F.col("url"), when=F.col("schema_truncated")))
