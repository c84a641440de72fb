"""DuckDB SQL for the audit's queries."""

from __future__ import annotations

import re
from collections import Counter
from urllib.parse import urljoin

from .functions.text import STOP_LIST
from .functions.urls import RESOURCE_EXTENSIONS
from .operators.network import prefix_rows
from .rules import GROUPS, PENALTIES, SEVERITIES, rule_rows
from .sample_site import ORIGIN, PAGES, START, expected
from .samples import values_sql
from .sources.structured import GENERAL, RECOMMENDED, REQUIRED

# ---------------------------------------------------------------- building blocks


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(nfc_normalize(coalesce({text}, ''))), '[\\p{{L}}\\p{{Nd}}]+'), lambda t: length(t) <= 40 AND t NOT IN ({STOP_LIST}))"


TOK = f"tok AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)"
GRAM = f"""{TOK}, gram AS (
  SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM tok), range(1, 4) AS r(k) WHERE i + k - 1 <= len(w)
)"""
UNI = f"{TOK}, cnt AS MATERIALIZED (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL)"
DF = "freq AS MATERIALIZED (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS total FROM cnt GROUP BY term)"
DOMINANT = "dom AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM cnt) WHERE rank <= 10)"
WEIGHED = f"""{UNI}, {DF}, total AS (SELECT count(*) AS docs FROM documents), weighed AS (
  SELECT doc_id, cnt.term, (1 + ln(n)) * (1 + ln((1 + docs) / (1 + df))) AS v FROM cnt JOIN freq USING (term), total
)"""
SITE = f"{WEIGHED}, site AS MATERIALIZED (SELECT term, sum(v) / any_value(docs) AS v FROM weighed, total GROUP BY term), strong AS MATERIALIZED (SELECT term, floor(v / (SELECT max(v) FROM site) * 1000 + 0.5) / 10 AS strength FROM site)"

_TEXT = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def unescaped(x: str) -> str:
    return _TEXT.format(x)


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_SAFE = {"%2F": "/", "%21": "!", "%24": "$", "%26": "&", "%27": "''", "%28": "(", "%29": ")", "%2A": "*", "%2B": "+", "%2C": ",", "%3B": ";", "%3D": "=", "%3A": ":", "%40": "@"}


def path_encoded(x: str) -> str:
    out = f"url_encode({x})"
    for code, plain in _SAFE.items():
        out = f"replace({out}, '{code}', '{plain}')"
    return out


SITE_KEY = "regexp_replace(lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') || CASE WHEN regexp_extract({0}, '^[A-Za-z]+://[^/?#:]*(:[0-9]+)', 1) IN ('', CASE WHEN {0} LIKE 'https%' THEN ':443' ELSE ':80' END) THEN '' ELSE regexp_extract({0}, '^[A-Za-z]+://[^/?#:]*(:[0-9]+)', 1) END"
URL = "u AS (SELECT page_id, html, regexp_replace(url, '#.*$', '') AS url FROM pages)"
PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
TITLE = squeezed(unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
H1 = squeezed(unescaped("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))
PAGE = f"{URL}, page AS (SELECT page_id, url, {TITLE} AS title, {H1} AS h1, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM u)"
LINKS = f"""{URL}, raw AS (
  SELECT page_id, url, pos, {unescaped("regexp_extract(tag, 'href=\"([^\"]*)\"', 1)")} AS href, {squeezed(unescaped("regexp_extract(tag, '>([^<]*)</a>', 1)"))} AS anchor
  FROM (SELECT page_id, url, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS tags FROM u))
), link AS (
  SELECT page_id, url, pos, anchor, regexp_extract(url, '^[a-z]+://[^/]+') || {path_encoded("regexp_replace(href, '[#?].*$', '')")} AS target FROM raw
)"""
QUOTED = "'\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"'"

_RULES = ", ".join(f"('{i}', {k}, '{s}', '{c}')" for i, k, s, c, _, _ in rule_rows())
RULE = f"rule(id, severity, severity_name, category) AS (VALUES {_RULES})"
_PENALTY = ", ".join(f"('{s}', {w})" for s, w in PENALTIES.items())
_ORDER = " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(GROUPS))


def doc_findings(name: str = "found", where: str = "true") -> str:
    """Findings over documents taken as pages."""
    return f"""{name}_d AS (SELECT * FROM documents WHERE {where}), {name}_b AS (
  SELECT doc_id, 'doc:' || doc_id AS url, len({tokens_sql("text")}) AS n, length(text) AS size, lang, sha256(text) AS sha FROM {name}_d
), {name}_g AS (SELECT min(doc_id) AS rep, list(doc_id ORDER BY doc_id) AS ids FROM {name}_b WHERE n > 0 GROUP BY sha HAVING count(*) > 1),
{name} AS (
  SELECT 'content' AS grp, 'SEO-CONTENT-003' AS id, url, CAST([] AS VARCHAR[]) AS evidence FROM {name}_b WHERE n = 0
  UNION ALL SELECT 'content', 'SEO-CONTENT-002', url, [] FROM {name}_b WHERE n BETWEEN 1 AND 39
  UNION ALL SELECT 'metadata', 'SEO-LANG-001', url, [] FROM {name}_b WHERE lang IS NULL
  UNION ALL SELECT 'metadata', 'SEO-TITLE-006', url, [size || ' characters'] FROM {name}_b WHERE size > 5000
  UNION ALL SELECT 'web-hygiene', 'WEB-HYGIENE-001', url, [] FROM {name}_b WHERE lang = 'de'
  UNION ALL SELECT 'content', 'SEO-DUPLICATE-001', 'doc:' || rep,
    list_transform(ids[2:21], lambda d: 'doc:' || d) || CASE WHEN len(ids) > 21 THEN ['... and ' || (len(ids) - 21) || ' more'] ELSE [] END FROM {name}_g
)"""


FNV = "list_reduce([CAST(14695981039346656037 AS HUGEINT)] || list_transform(range(strlen({0})), lambda i: CAST(('0x' || hex({0})[2 * i + 1 : 2 * i + 2]) AS HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
HASHES = f"""rep AS (SELECT min(doc_id) AS doc_id, any_value(w) AS w FROM (SELECT doc_id, sha256(text) AS sha, {tokens_sql("text")} AS w FROM documents) WHERE len(w) > 0 GROUP BY sha),
words AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(w) AS token FROM rep) GROUP BY ALL),
hashed AS (SELECT token, {FNV.format("token")} AS h FROM (SELECT DISTINCT token FROM words)),
votes AS (SELECT doc_id, bit, sum(CASE WHEN (h >> bit) % 2 = 1 THEN n ELSE -n END) AS v FROM words JOIN hashed USING (token), range(64) AS r(bit) GROUP BY doc_id, bit),
sim AS (SELECT doc_id, CAST(sum(CASE WHEN v < 0 THEN CAST(1 AS HUGEINT) << CAST(bit AS INTEGER) ELSE 0 END) AS UBIGINT) AS h FROM votes GROUP BY doc_id)"""
PAIRS = f"{HASHES}, pair AS (SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.h, b.h)) AS distance FROM sim a JOIN sim b ON a.doc_id < b.doc_id AND bit_count(xor(a.h, b.h)) <= 5)"

GRAPH = """c AS (SELECT c_custkey AS i, (SELECT count(*) FROM customer) AS n FROM customer),
page AS (SELECT i, 'https://s.test/' || i AS url, i % 5 <> 0 AS indexable, i = 1 AS is_start, i % 11 = 0 AS failed FROM c),
link AS (SELECT 'https://s.test/' || i AS source, k, 'https://s.test/' || ((i + k) % n) AS target, (i + k - 1) % 7 = 0 AS nofollow, 'anchor ' || ((i + k) % 50) AS anchor, i % 5 <> 0 AS indexable FROM c, range(20) AS r(k)),
uniq AS (SELECT * FROM link QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY k) = 1),
inb AS (SELECT target AS url, count(*) AS n FROM uniq WHERE indexable AND NOT nofollow AND source <> target AND target IN (SELECT url FROM page) GROUP BY target)"""

CRAWL_DEPTH, CRAWL_PAGES = 10, 500


def crawled(with_robots: bool) -> str:
    """A breadth-first crawl with the default limits, a level for each depth: levelK (url), judgedK (url, reason)."""
    name = "'https://s.test/' || translate(CAST({} AS VARCHAR), '0123456789', 'abcdefghij')"
    out = [f"""c AS (SELECT c_custkey AS i, (SELECT count(*) FROM customer) AS n FROM customer), shut AS (SELECT {name.format("i")} AS url FROM c WHERE {"i % 11 = 0" if with_robots else "false"}),
link AS MATERIALIZED (SELECT {name.format("i")} AS source, {name.format("((3 * i + j + 1) % n)")} AS target FROM c, range(20) AS r(j)), level0 AS (SELECT {name.format("1")} AS url)"""]
    for k in range(1, CRAWL_DEPTH + 2):
        seen = " UNION ALL ".join(["SELECT url FROM level0", *(f"SELECT url FROM judged{m}" for m in range(1, k))])
        pages = " + ".join(f"(SELECT count(*) FROM level{m})" for m in range(k))
        new = f"SELECT DISTINCT target AS url FROM level{k - 1} JOIN link ON source = url WHERE target NOT IN ({seen})"
        reason = f"CASE WHEN url IN (SELECT url FROM shut) THEN 'robots-disallowed' WHEN row_number() OVER (PARTITION BY url IN (SELECT url FROM shut) ORDER BY url) > {CRAWL_PAGES} - ({pages}) THEN 'max-pages' END" if k <= CRAWL_DEPTH else "'max-depth'"
        out.append(f"judged{k} AS MATERIALIZED (SELECT url, {reason} AS reason FROM ({new}))")
        out.append(f"level{k} AS MATERIALIZED (SELECT url FROM judged{k} WHERE reason IS NULL)")
    return ", ".join(out)


_FETCHED = values_sql("fetched")
TARGETS = f"""{_FETCHED}, states AS (
  SELECT p.url, p.canonical,
    CASE WHEN f.error <> '' THEN 'error' WHEN f.status >= 400 THEN 'status' WHEN f.redirects > 0 THEN 'redirect' ELSE 'ok' END AS state,
    CASE WHEN f.error <> '' THEN 'error: ' || f.error WHEN f.status >= 400 THEN 'HTTP status ' || f.status WHEN f.redirects > 0 THEN 'redirects to ' || f.final_url END AS detail
  FROM fetched p JOIN fetched f ON p.canonical = f.url WHERE p.canonical <> '' AND p.canonical <> p.url
)"""
_ALT = values_sql("alternates")
_ASKED = f"{values_sql('robots_rules')}, {values_sql('robots_asked')}"
ROBOTS = f"""{_ASKED}, who AS (SELECT DISTINCT asked FROM robots_asked),
own AS (SELECT r.*, asked FROM robots_rules r, who WHERE asked <> '*' AND agent <> '*' AND regexp_extract(agent, '^[^/ ]*') = asked),
rules AS (SELECT * FROM own UNION ALL SELECT r.*, asked FROM robots_rules r, who WHERE agent = '*' AND NOT EXISTS (SELECT 1 FROM own o WHERE o.origin = r.origin AND o.asked = who.asked)),
usable AS (SELECT * FROM rules WHERE pattern IS NOT NULL)"""
_LANGS = "'en', 'de', 'fr', 'zh', 'pt'"
ALTF = f"""{_ALT}, decl AS (SELECT *, lower(target) AS k FROM alternates),
valid AS (SELECT *, k = 'x-default' OR (regexp_matches(k, '^[a-z]{{2}}(-[a-z]{{4}})?(-[a-z]{{2}})?$') AND k[1:2] IN ({_LANGS}) AND NOT ends_with(k, '-uk')) AS ok FROM decl),
own AS (SELECT * FROM decl WHERE href = url AND k <> 'x-default')"""

MAIN = unescaped("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')")
ZONES = f"""{URL}, zone AS (
  SELECT page_id, 4 AS w, true AS meta, false AS heading, {tokens_sql(TITLE)} AS ts FROM u
  UNION ALL SELECT page_id, 3, false, true, {tokens_sql(H1)} FROM u
  UNION ALL SELECT page_id, 1, false, false, {tokens_sql(MAIN)} FROM u
), cnt AS (SELECT page_id, term, sum(w) AS n, bool_or(meta) AS meta, bool_or(heading) AS heading FROM (SELECT page_id, w, meta, heading, unnest(ts) AS term FROM zone) GROUP BY ALL)"""

def site_crawl(most: int) -> Counter:
    """What ``audit_crawl`` reports, by a plain walk over the sample site's pages (SQL has no HTML)."""
    html = {ORIGIN + p["path"]: p["html"] for p in PAGES if p["status"] == 200 and p["html"]}
    asked = {ORIGIN + p["path"] for p in PAGES}
    level, seen, depth, taken, out = [START], {START}, 0, 1, Counter({"depth 0": 1})
    while level:
        found = {urljoin(url, ref) for url in level for ref in re.findall(r'<(?:a href|img src)="([^"]+)"', html.get(url, ""))}
        new = sorted(u for u in found - seen if u.partition("://")[2].startswith("site.test"))
        seen.update(new)
        depth += 1
        free = [u for u in new if u != f"{ORIGIN}/orphan"]
        level = free[: most - taken]
        taken += len(level)
        out.update({f"depth {depth}": len(asked.intersection(level)), "skipped robots-disallowed": len(new) - len(free), "skipped max-pages": len(free) - len(level)})
    out[f"stopped {'max-pages' if out['skipped max-pages'] else 'completed'}"] = sum(n for what, n in out.items() if what.startswith("depth"))
    return +out


ORACLES: dict[str, str] = {
    # text
    "weak_terms": f"""WITH {ZONES}, freq AS (SELECT term, count(*) AS df FROM cnt GROUP BY term), total AS (SELECT count(*) AS docs FROM pages),
site AS (SELECT term, sum((1 + ln(n)) * (1 + ln((1 + docs) / (1 + df)))) / any_value(docs) AS v, bool_or(meta) AS meta, bool_or(heading) AS heading FROM cnt JOIN freq USING (term), total GROUP BY term),
strong AS (SELECT *, floor(v / max(v) OVER () * 1000 + 0.5) / 10 AS strength, length(regexp_replace(term, '\\P{{L}}', '', 'g')) AS letters, length(term) AS size FROM site),
fit AS (SELECT term, strength, CASE WHEN meta THEN 0 WHEN heading THEN 1 ELSE 2 END AS tier FROM strong WHERE strength > 0 AND strength < 50 AND letters > 0 AND size >= 2 AND (letters >= 3 OR (size >= 3 AND letters >= 2)))
SELECT row_number() OVER (ORDER BY tier, strength, term) AS rank, term, strength, CAST(tier AS BIGINT) AS tier FROM fit ORDER BY tier, strength, term LIMIT 10""",
    "tokenize_documents": f"WITH {TOK} SELECT doc_id, array_to_string(w, ' ') AS tokens FROM tok",
    "token_counts": f"WITH {TOK} SELECT doc_id, len(w) AS n_tokens FROM tok",
    "thin_content": f"WITH {TOK} SELECT doc_id, CASE WHEN len(w) = 0 THEN 'SEO-CONTENT-003' ELSE 'SEO-CONTENT-002' END AS rule FROM tok WHERE len(w) < 40",
    "ngram_frequency": f"WITH {GRAM} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM gram GROUP BY term HAVING count(DISTINCT doc_id) >= 2",
    "ngram_top10_per_doc": f"WITH {GRAM}, cnt AS (SELECT doc_id, term, count(*) AS n FROM gram GROUP BY ALL), {DOMINANT} SELECT doc_id, rank, term, n FROM dom",
    "doc_frequency": f"WITH {UNI}, {DF} SELECT term, df, total FROM freq",
    "site_wide_terms": f"WITH {UNI}, {DF}, total AS (SELECT count(*) AS docs FROM documents) SELECT term, df, freq.total, format('{{:.1f}}%', floor(df / docs * 1000 + 0.5) / 10) AS strength FROM freq, total WHERE df / docs >= 0.1 ORDER BY df DESC, freq.total DESC, term LIMIT 20",
    "tfidf_page_top20": f"WITH {WEIGHED}, s AS (SELECT doc_id, term, floor(v / max(v) OVER (PARTITION BY doc_id) * 1000 + 0.5) / 10 AS strength FROM weighed) SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY strength DESC, term) AS rank, term, strength FROM s) WHERE rank <= 20",
    "tfidf_site_top20": f"WITH {SITE} SELECT term, strength FROM strong ORDER BY strength DESC, term LIMIT 20",
    "keyword_strength": f"WITH {SITE}, top AS MATERIALIZED (SELECT term, strength FROM strong ORDER BY strength DESC, term LIMIT 20), asked(term) AS (VALUES ('licensed'), ('apache license'), ('missingword')) SELECT term, strength FROM top UNION ALL SELECT asked.term, coalesce(strong.strength, 0.0) FROM asked LEFT JOIN strong USING (term) LEFT JOIN top ON top.term = asked.term WHERE top.term IS NULL",
    "page_specific_terms": f"WITH {UNI}, {DF}, {DOMINANT} SELECT doc_id, string_agg(term, ',' ORDER BY rank) AS terms FROM dom JOIN freq USING (term) WHERE df <= 1 GROUP BY doc_id",
    "duplicate_profiles": f"WITH {UNI}, {DOMINANT}, sig AS (SELECT doc_id, string_agg(term, '|' ORDER BY rank) AS profile FROM dom GROUP BY doc_id) SELECT doc_id, profile FROM (SELECT *, min(doc_id) OVER (PARTITION BY profile) AS first FROM sig) WHERE doc_id > first",
    "keyword_predicate": f"WITH {values_sql('terms')}, w AS (SELECT term, string_split(term, ' ') AS ws FROM terms), l AS (SELECT term, list_transform(ws, lambda x: length(regexp_replace(x, '\\P{{L}}', '', 'g'))) AS ls, list_transform(ws, lambda x: length(x)) AS ns FROM w) SELECT term, list_min(ls) > 0 AND list_min(ns) >= 2 AND len(list_filter(list_zip(ls, ns), lambda z: z[1] >= 3 OR (z[2] >= 3 AND z[1] >= 2))) > 0 AS is_keyword FROM l",
    "evidence_text": "SELECT doc_id, CASE WHEN length(text) > 300 THEN text[1:299] || '…' ELSE text END AS line FROM documents",
    "gram_counts": f"WITH {TOK} SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) = 1 THEN 1 ELSE 3 * len(w) - 3 END AS n_grams FROM tok",
    # duplicates
    "exact_duplicates": f"WITH {TOK}, d AS (SELECT sha256(text) AS sha, doc_id FROM documents JOIN tok USING (doc_id) WHERE len(w) > 0), g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS representative FROM d) SELECT representative, doc_id AS duplicate FROM g WHERE doc_id > representative",
    "fnv1a_tokens": f"WITH {TOK}, t AS (SELECT DISTINCT unnest(w) AS token FROM tok) SELECT token, lpad(lower(to_hex(CAST({FNV.format('token')} AS UBIGINT))), 16, '0') AS fnv FROM t",
    "simhash_documents": f"WITH {HASHES} SELECT doc_id, lpad(lower(to_hex(h)), 16, '0') AS simhash FROM sim",
    "near_duplicate_pairs": f"WITH {PAIRS}, near AS (SELECT k AS doc_id, count(*) AS n FROM (SELECT a AS k FROM pair UNION ALL SELECT b FROM pair) GROUP BY k) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS links FROM sim LEFT JOIN near USING (doc_id)",
    # urls
    "site_keys": f"WITH {URL} SELECT {SITE_KEY.format('url')} AS site, count(*) AS n FROM u GROUP BY 1",
    "url_patterns": f"WITH {URL}, p AS (SELECT regexp_replace({PATH}, '[0-9]+', '{{n}}', 'g') AS path, {QUERY} AS q FROM u) SELECT CASE WHEN q = '' THEN path ELSE path || '?' || array_to_string(list_sort(list_transform(string_split(q, '&'), lambda x: regexp_replace(split_part(x, '=', 1), '[0-9]+', '{{n}}', 'g'))), '&') END AS pattern, count(*) AS n FROM p GROUP BY 1",
    "url_parts": f"WITH {URL} SELECT page_id, {PATH} AS path, {QUERY} AS query FROM u",
    "resource_urls": f"SELECT p_partkey, ['pdf', 'html', 'js', '', 'gz'][p_size % 5 + 1] IN ({', '.join(repr(e) for e in RESOURCE_EXTENSIONS)}) AS is_resource FROM part",
    "normalized_urls": f"WITH {values_sql('urls_in')} SELECT id, normal FROM urls_in",
    "crawl_traps": """WITH u AS (SELECT 'https://s.test/cal/' || i AS url, '' AS q, 'cal' AS kind, i FROM range(150) r(i)
  UNION ALL SELECT 'https://s.test/list?' || chr(CAST(97 + i % 20 AS INT)) || i || '=1', 'q', 'list', i FROM range(40) r(i)
  UNION ALL SELECT 'https://s.test/d' || repeat('/x', CAST(i AS INT)), '', 'deep', i FROM range(40) r(i)),
j AS (SELECT url, CASE WHEN kind = 'deep' AND i + 1 > 30 THEN 'too-many-path-segments' WHEN kind = 'deep' AND i > 3 THEN 'repeated-path-segment'
  WHEN kind = 'list' AND row_number() OVER (PARTITION BY kind ORDER BY url) > 25 THEN 'query-explosion'
  WHEN kind = 'cal' AND row_number() OVER (PARTITION BY kind ORDER BY url) > 100 THEN 'path-pattern-explosion' ELSE '' END AS trap FROM u)
SELECT trap, count(*) AS n, min(url) AS first_url FROM j GROUP BY trap""",
    # pages
    "page_titles": f"WITH {PAGE} SELECT page_id, title, CAST(1 AS BIGINT) AS n FROM page",
    "title_findings": f"WITH {PAGE} SELECT CASE WHEN title = '' THEN 'SEO-TITLE-002' WHEN length(title) < 15 THEN 'SEO-TITLE-005' ELSE 'SEO-TITLE-006' END AS id, url FROM page WHERE length(title) < 15 OR length(title) > 65",
    "duplicate_titles": f"WITH {PAGE}, g AS (SELECT title, list(url ORDER BY url) AS urls FROM page WHERE title <> '' GROUP BY title HAVING count(*) > 1), m AS (SELECT title, urls, unnest(urls) AS url FROM g) SELECT url, {QUOTED.format('title')} AS title, CAST(len(urls) - count(*) OVER (PARTITION BY title, url) AS BIGINT) AS others FROM m",
    "duplicate_h1": f"WITH {PAGE}, g AS (SELECT lower(h1) AS h, list(url ORDER BY url) AS urls FROM page WHERE h1 <> '' GROUP BY 1 HAVING count(*) > 1), m AS (SELECT h, urls, unnest(urls) AS url FROM g) SELECT url, {QUOTED.format('h')} AS h1, array_to_string([{QUOTED.format('h')}] || list_transform(list_filter(urls[1:21], lambda x: x <> url), lambda x: 'also on ' || x), '|') AS evidence FROM m",
    "page_lang_counts": f"WITH {PAGE} SELECT lang, count(*) AS n FROM page GROUP BY lang",
    "page_links": f"WITH {LINKS} SELECT page_id, pos, target AS url, anchor FROM link",
    "outbound_counts": f"WITH {LINKS}, o AS (SELECT url, count(DISTINCT target) AS n FROM link WHERE target <> url GROUP BY url), i AS (SELECT target AS url, count(DISTINCT link.url) AS m FROM link WHERE target <> link.url GROUP BY target) SELECT DISTINCT u.url, coalesce(m, 0) AS inbound, coalesce(n, 0) AS outbound FROM u LEFT JOIN o USING (url) LEFT JOIN i USING (url)",
    "anchor_reuse_page": f"WITH {LINKS} SELECT url, lower(anchor) AS anchor, count(*) AS n, count(DISTINCT target) AS targets FROM link WHERE anchor <> '' AND NOT regexp_matches(lower(target), '\\.({'|'.join(RESOURCE_EXTENSIONS)})$') GROUP BY 1, 2 HAVING count(DISTINCT target) >= 2",
    "anchor_reuse_site": f"WITH {LINKS} SELECT lower(anchor) AS anchor, count(DISTINCT target) AS targets FROM link WHERE trim(anchor) <> '' GROUP BY 1 HAVING count(DISTINCT target) >= 2",
    "page_findings": f"""WITH {PAGE}, {RULE}, k(id, n, grp) AS (
  SELECT CASE WHEN title = '' THEN 'SEO-TITLE-002' WHEN length(title) < 15 THEN 'SEO-TITLE-005' ELSE 'SEO-TITLE-006' END, count(*), 'metadata' FROM page WHERE length(title) NOT BETWEEN 15 AND 65 GROUP BY 1
  UNION ALL SELECT 'SEO-HEADING-003', count(*), 'metadata' FROM page WHERE h1 = ''
  UNION ALL SELECT unnest(['SEO-DESC-001', 'SEO-CANONICAL-001']), count(*), 'metadata' FROM page
  UNION ALL SELECT unnest(['WEB-HYGIENE-002', 'WEB-HYGIENE-003', 'WEB-HYGIENE-007', 'WEB-HYGIENE-008']), count(*), 'web-hygiene' FROM page
  UNION ALL SELECT CASE WHEN url LIKE 'https:%' THEN 'WEB-HYGIENE-006' ELSE 'WEB-HYGIENE-001' END, count(*), 'web-hygiene' FROM page GROUP BY 1
) SELECT id, severity_name, category, grp, n FROM k JOIN rule USING (id) WHERE n > 0""",
    # link graph
    "link_graph_inbound": f"WITH {GRAPH} SELECT url, n FROM inb",
    "link_orphans": f"WITH {GRAPH} SELECT 'SEO-LINK-001' AS id, url FROM page WHERE indexable AND NOT is_start AND url NOT IN (SELECT url FROM inb)",
    "self_links": f"WITH {GRAPH} SELECT DISTINCT 'SEO-LINK-002' AS id, source AS url FROM link WHERE source = target",
    "broken_links": f"WITH {GRAPH} SELECT DISTINCT target FROM uniq WHERE target IN (SELECT url FROM page WHERE failed)",
    "anchor_targets": f"WITH {GRAPH} SELECT anchor, count(DISTINCT target) AS targets FROM uniq WHERE indexable AND target IN (SELECT url FROM page) GROUP BY anchor HAVING count(DISTINCT target) >= 2",
    # canonical, hreflang
    "canonical_targets": f"WITH {TARGETS} SELECT url, canonical, state, detail FROM states",
    "canonical_chains": f"""WITH RECURSIVE {TARGETS}, walk(url, path, loops, over) AS (
  SELECT url, [url, canonical], false, false FROM states WHERE state = 'ok'
  UNION ALL
  SELECT w.url, CASE WHEN f.canonical = '' OR f.canonical = f.url THEN w.path ELSE w.path || [f.canonical] END, f.canonical <> '' AND f.canonical <> f.url AND list_contains(w.path, f.canonical),
    f.canonical = '' OR f.canonical = f.url OR list_contains(w.path, f.canonical)
  FROM walk w JOIN fetched f ON f.url = w.path[-1] WHERE NOT w.over AND len(w.path) < 22
)
SELECT url, array_to_string(arg_max(path, len(path) * 2 + CAST(over AS INT)), ' -> ') AS path, bool_or(loops) AS loops FROM walk GROUP BY url""",
    "hreflang_reciprocity": f"WITH {_ALT} SELECT a.url, a.href AS target FROM alternates a WHERE a.url <> a.href AND a.href IN (SELECT url FROM alternates) AND NOT EXISTS (SELECT 1 FROM alternates b WHERE b.url = a.href AND b.href = a.url)",
    "hreflang_conflicts": f"WITH {_ALT}, l AS (SELECT *, lower(target) AS k, lag(href) OVER (PARTITION BY url, lower(target) ORDER BY pos) AS before FROM alternates) SELECT url, k || ' ' || before || ' ' || href AS evidence FROM l WHERE before <> href",
    "hreflang_findings": f"""WITH {ALTF}
SELECT 'SEO-HREFLANG-003' AS id, url, target AS evidence FROM valid WHERE NOT ok
UNION ALL SELECT 'SEO-LANG-003', url, 'en ' || target FROM own WHERE split_part(k, '-', 1) <> 'en'
UNION ALL SELECT DISTINCT 'SEO-HREFLANG-004', url, '' FROM decl WHERE url NOT IN (SELECT url FROM own)
UNION ALL SELECT 'SEO-HREFLANG-005', url, '' FROM decl GROUP BY url HAVING count(DISTINCT k) > 1 AND count(*) FILTER (k = 'x-default') = 0
UNION ALL SELECT 'SEO-HREFLANG-007', a.url, a.href FROM decl a WHERE a.url <> a.href AND a.href IN (SELECT url FROM decl) AND NOT EXISTS (SELECT 1 FROM decl b WHERE b.url = a.href AND b.href = a.url)
UNION ALL SELECT 'SEO-HREFLANG-006', url, href FROM decl WHERE url <> href AND href = 'https://s.test/de'""",
    # robots
    "robots_match": f"""WITH {ROBOTS}, fit AS (
  SELECT a.origin, a.asked, a.path, u.allow, u.pattern FROM robots_asked a JOIN usable u USING (origin, asked)
  WHERE a.path <> '/robots.txt' AND regexp_matches(a.path, '^' || replace(replace(replace(replace(regexp_replace(pattern, '\\$$', ''), '.', '\\.'), '?', '\\?'), '*', '.*'), '$', '\\$') || CASE WHEN ends_with(pattern, '$') THEN '$' ELSE '' END)
), best AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY origin, asked, path ORDER BY length(pattern) DESC, allow DESC) = 1)
SELECT a.origin, a.asked, a.path, coalesce(allow, true) AS allowed, pattern FROM robots_asked a LEFT JOIN best USING (origin, asked, path)""",
    "robots_agent_fallback": f"WITH {ROBOTS} SELECT origin, asked, count(*) AS n, CAST(min(line) AS BIGINT) AS first_line FROM usable GROUP BY ALL",
    "robots_meta_fold": f"""WITH {values_sql("robots_meta")}, piece AS (
  SELECT url, trim(p) AS p FROM (SELECT url, unnest(string_split(value, ',')) AS p FROM robots_meta WHERE agent IN ('robots', 'googlebot')) WHERE trim(p) <> ''
), d AS (SELECT url, p, lower(trim(split_part(p, ':', 1))) AS k, CASE WHEN contains(p, ':') THEN trim(regexp_replace(p, '^[^:]*:', '')) END AS arg FROM piece),
g AS (SELECT *, coalesce(CASE WHEN k IN ('max-snippet', 'max-video-preview') THEN TRY_CAST(arg AS INT) >= -1 WHEN k = 'max-image-preview' THEN arg IN ('none', 'standard', 'large') WHEN k = 'unavailable_after' THEN arg <> ''
  ELSE k IN ('index', 'noindex', 'follow', 'nofollow', 'none', 'all', 'noarchive', 'nocache', 'nosnippet', 'noimageindex', 'notranslate', 'indexifembedded', 'noodp', 'noydir') END, false) AS good FROM d),
urls AS (SELECT DISTINCT url FROM robots_meta)
SELECT url, coalesce(bool_or(k IN ('noindex', 'none')), false) AS noindex, coalesce(bool_or(k IN ('nofollow', 'none')), false) AS nofollow, coalesce(bool_or(k IN ('noarchive', 'nocache')), false) AS noarchive,
  coalesce(bool_or(k = 'nosnippet'), false) AS nosnippet, coalesce(bool_or(k IN ('index', 'all')), false) AS explicit_index, coalesce(bool_or(k IN ('follow', 'all')), false) AS explicit_follow,
  coalesce(min(TRY_CAST(arg AS INT)) FILTER (k = 'max-snippet' AND good AND arg <> '-1'), min(TRY_CAST(arg AS INT)) FILTER (k = 'max-snippet' AND good)) AS max_snippet,
  arg_min(arg, list_position(['none', 'standard', 'large'], arg)) FILTER (k = 'max-image-preview' AND good) AS max_preview, count(*) FILTER (NOT good) AS bad
FROM urls LEFT JOIN g USING (url) GROUP BY url""",
    # social, images, headings, headers, structured data
    "social_findings": f"""WITH {values_sql("social")}, last AS (SELECT url, property, arg_max(value, pos) AS v FROM social GROUP BY ALL),
p AS (SELECT url, map_from_entries(list((property, v))) AS m FROM last GROUP BY url),
q AS (SELECT url, m, bool_or(property LIKE 'og:_%') AS og, bool_or(property LIKE 'twitter:_%') AS tw FROM p JOIN last USING (url) GROUP BY ALL),
need AS (SELECT url, list_filter([
  CASE WHEN og AND coalesce(m['og:title'], '') = '' THEN 'og:title' END, CASE WHEN og AND coalesce(m['og:type'], '') = '' THEN 'og:type' END, CASE WHEN og AND coalesce(m['og:url'], '') = '' THEN 'og:url' END,
  CASE WHEN og AND coalesce(m['og:image'], '') = '' THEN 'og:image' END, CASE WHEN tw AND coalesce(m['twitter:card'], '') = '' THEN 'twitter:card' END,
  CASE WHEN tw AND coalesce(m['twitter:title'], '') = '' AND coalesce(m['og:title'], '') = '' THEN 'twitter:title or og:title' END,
  CASE WHEN tw AND coalesce(m['twitter:image'], '') = '' AND coalesce(m['og:image'], '') = '' THEN 'twitter:image or og:image' END], lambda x: x IS NOT NULL) AS lacks FROM q)
SELECT 'SEO-SOCIAL-002' AS id, url, 'og:title: ' || m['og:title'] || '|twitter:title: ' || m['twitter:title'] AS evidence FROM q WHERE m['twitter:title'] <> '' AND lower(m['og:title']) <> lower(m['twitter:title'])
UNION ALL SELECT 'SEO-SOCIAL-004', url, string_agg('og:image: ' || value, '|' ORDER BY pos) FROM social WHERE property IN ('og:image', 'twitter:image') AND value <> '' AND NOT regexp_matches(value, '^https?://') GROUP BY url
UNION ALL SELECT 'SEO-SOCIAL-005', url, array_to_string(lacks, '|') FROM need WHERE len(lacks) > 0""",
    "image_findings": f"WITH {values_sql('images')} SELECT 'SEO-IMAGE-001' AS id, url, src AS evidence FROM images WHERE NOT has_alt UNION ALL SELECT 'SEO-IMAGE-002', url, src FROM images WHERE width <= 0 OR height <= 0 UNION ALL SELECT 'SEO-IMAGE-003', url, src || '|' || loading FROM images WHERE loading NOT IN ('', 'lazy', 'eager')",
    "heading_findings": f"""WITH {values_sql("headings")}, h AS (SELECT *, lag(level) OVER (PARTITION BY url ORDER BY pos) AS before FROM headings)
SELECT 'SEO-HEADING-001' AS id, url, CAST(0 AS BIGINT) AS n FROM h GROUP BY url HAVING count(*) FILTER (level = 1) = 0
UNION ALL SELECT 'SEO-HEADING-002', url, count(*) FILTER (level = 1) FROM h GROUP BY url HAVING count(*) FILTER (level = 1) > 1
UNION ALL SELECT 'SEO-HEADING-003', url, count(*) FROM h WHERE text = '' GROUP BY url
UNION ALL SELECT 'SEO-HEADING-004', url, count(*) FROM h WHERE (before IS NULL AND level > 1) OR level > before + 1 GROUP BY url""",
    "hygiene_headers": f"""WITH {values_sql("headers")}, h AS (SELECT url, max(value) FILTER (lower(name) = 'strict-transport-security') AS hsts, max(value) FILTER (lower(name) = 'x-content-type-options') AS sniff,
  max(value) FILTER (lower(name) = 'referrer-policy') AS ref, max(value) FILTER (lower(name) = 'content-security-policy') AS csp, max(value) FILTER (lower(name) = 'x-frame-options') AS xfo FROM headers GROUP BY url)
SELECT 'WEB-HYGIENE-001' AS id, url, '' AS evidence FROM h WHERE url NOT LIKE 'https://%'
UNION ALL SELECT 'WEB-HYGIENE-006', url, CASE WHEN hsts IS NULL THEN 'missing' ELSE 'value: ' || hsts END FROM h WHERE url LIKE 'https://%' AND coalesce(lower(hsts), '') NOT LIKE '%max-age%'
UNION ALL SELECT 'WEB-HYGIENE-002', url, CASE WHEN sniff IS NULL THEN 'missing' ELSE 'value: ' || sniff END FROM h WHERE coalesce(lower(sniff), '') <> 'nosniff'
UNION ALL SELECT 'WEB-HYGIENE-003', url, '' FROM h WHERE ref IS NULL UNION ALL SELECT 'WEB-HYGIENE-007', url, '' FROM h WHERE csp IS NULL
UNION ALL SELECT 'WEB-HYGIENE-008', url, '' FROM h WHERE xfo IS NULL AND coalesce(csp, '') NOT LIKE '%frame-ancestors%'""",
    "schema_properties": f"""WITH {values_sql("schema_items")}, alias(type, general) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in GENERAL.items())}),
need(general, k, names, required) AS (VALUES {", ".join([f"('{g}', {i}, '{x}', true)" for g, xs in REQUIRED.items() for i, x in enumerate(xs)] + [f"('{g}', {100 + i}, '{x}', false)" for g, xs in RECOMMENDED.items() for i, x in enumerate(xs.split())])}),
item AS (SELECT DISTINCT url, item, type, top FROM schema_items)
SELECT i.url, '[' || CAST(i.item - 1 AS VARCHAR) || CASE WHEN i.top THEN ']' ELSE '] > about' END AS path, i.type, required, array_to_string(list_sort(string_split(names, '|')), '|') AS property FROM item i JOIN alias USING (type) JOIN need USING (general)
WHERE (required OR top) AND NOT EXISTS (SELECT 1 FROM schema_items s WHERE s.url = i.url AND s.item = i.item AND trim(s.value) <> '' AND list_contains(string_split(names, '|'), s.property))""",
    "breadcrumb_checks": f"""WITH {values_sql("crumbs")}, c AS (SELECT *, max(idx) OVER (PARTITION BY url, list) AS n, min(idx) OVER (PARTITION BY url, list, position) AS fp, min(idx) OVER (PARTITION BY url, list, item) AS fi FROM crumbs),
g AS (SELECT url, list, count(*) FILTER ((position > 0 AND fp < idx) OR (item <> '' AND fi < idx)) AS repeats, count(*) FILTER (name = '') AS nameless, count(*) FILTER (item = '' AND idx < n) AS targetless, list_distinct(list(position)) AS ps, max(n) AS n FROM c GROUP BY url, list)
SELECT url, repeats, nameless, targetless, CASE WHEN repeats = 0 AND len(ps) = n THEN list_min(list_filter(range(1, n + 1), lambda x: NOT list_contains(ps, x))) END AS gap FROM g""",
    # sitemaps
    "sitemap_vs_crawl": f"""WITH {values_sql("sitemap_listed")}, {_FETCHED}, l AS (SELECT DISTINCT url FROM sitemap_listed)
SELECT 'SEO-SITEMAP-010' AS id, url, '' AS evidence FROM l JOIN fetched f USING (url) WHERE f.error <> '' OR f.status >= 400 OR f.redirects > 0 OR (f.canonical <> '' AND f.canonical <> url)
UNION ALL SELECT 'SEO-SITEMAP-010', url, 'disallowed by robots.txt' FROM l WHERE url = 'https://s.test/c'""",
    "sitemap_scope": f"WITH {values_sql('sitemap_listed')} SELECT url, lastmod, {SITE_KEY.format('url')} = site AS in_scope FROM sitemap_listed",
    # findings
    "findings_by_rule": f"WITH {doc_findings()}, {RULE} SELECT id, grp, severity_name, category, count(*) AS n FROM found JOIN rule USING (id) GROUP BY ALL",
    "severity_counts": f"WITH {doc_findings()}, {RULE}, level(severity_name) AS (VALUES {', '.join(f"('{s}')" for s in SEVERITIES)}), k AS (SELECT severity_name, count(*) AS n FROM found JOIN rule USING (id) GROUP BY 1) SELECT severity_name, coalesce(n, 0) AS n FROM level LEFT JOIN k USING (severity_name)",
    "audit_scores": f"WITH {doc_findings()}, {RULE}, pen(severity_name, w) AS (VALUES {_PENALTY}), s AS (SELECT coalesce(sum(w) FILTER (grp <> 'web-hygiene'), 0) AS o, coalesce(sum(w) FILTER (grp = 'web-hygiene'), 0) AS h FROM found JOIN rule USING (id) JOIN pen USING (severity_name)), n AS (SELECT count(*) AS n FROM documents) SELECT CAST(greatest(0, 100 - o // n) AS INTEGER) AS seo, CAST(greatest(0, 100 - h // n) AS INTEGER) AS web_hygiene FROM s, n",
    "quick_wins": f"WITH {doc_findings()}, {RULE}, f AS (SELECT *, CASE grp {_ORDER} END AS g FROM found JOIN rule USING (id)), one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY severity DESC, g, url, evidence) = 1) SELECT id, severity_name, grp, url, array_to_string(evidence, '|') AS evidence FROM one ORDER BY severity DESC, g, id, url LIMIT 8",
    "report_diff": f"""WITH {doc_findings("cur", "source <> 'src1'")}, {doc_findings("base", "source <> 'src2'")}, a AS (SELECT DISTINCT id, url, array_to_string(evidence, '|') AS evidence FROM cur), b AS (SELECT DISTINCT id, url, array_to_string(evidence, '|') AS evidence FROM base)
SELECT 'new' AS change, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'resolved', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "group_diff": f"""WITH {doc_findings("cur", "source <> 'src1'")}, {doc_findings("base", "source <> 'src2'")}, a AS (SELECT DISTINCT grp FROM cur WHERE grp <> 'metadata'), b AS (SELECT DISTINCT grp FROM base WHERE grp <> 'content')
SELECT grp, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT grp, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    # crawl, network, log
    "crawl_levels": f"WITH {crawled(False)} " + " UNION ALL ".join(f"SELECT url, CAST({k} AS BIGINT) AS depth FROM level{k}" for k in range(CRAWL_DEPTH + 1)),
    "crawl_skips": f"WITH {crawled(True)}, skip AS ({' UNION ALL '.join(f'SELECT reason FROM judged{k} WHERE reason IS NOT NULL' for k in range(1, CRAWL_DEPTH + 2))}), page AS ({' UNION ALL '.join(f'SELECT url FROM level{k}' for k in range(CRAWL_DEPTH + 1))}) SELECT 's.test' AS site, reason, count(*) AS n FROM skip GROUP BY reason UNION ALL SELECT 's.test', 'stopped: ' || (SELECT CASE WHEN bool_or(reason = 'max-pages') THEN 'max-pages' WHEN bool_or(reason = 'max-depth') THEN 'max-depth' ELSE 'completed' END FROM skip), count(*) FROM page",
    "near_duplicate_groups": f"""WITH RECURSIVE {PAIRS.replace("WITH ", "").replace("pair AS", "pair AS MATERIALIZED")}, node AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM (SELECT a AS k FROM pair UNION SELECT b FROM pair)),
near AS MATERIALIZED (SELECT i, k, coalesce(list(a) FILTER (a IS NOT NULL), []) AS before FROM node LEFT JOIN pair ON b = k GROUP BY i, k),
walk(i, leaders) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT near.i, CASE WHEN list_has_any(leaders, before) THEN leaders ELSE list_append(leaders, k) END FROM walk JOIN near ON near.i = walk.i + 1),
ends AS (SELECT arg_max(leaders, i) AS leaders FROM walk)
SELECT min(a) AS representative, b AS duplicate FROM pair, ends WHERE list_contains(leaders, a) AND NOT list_contains(leaders, b) GROUP BY b""",
    "rate_limiter_schedule": "WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS due, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)) SELECT event_id, CAST(n * 200000 + max(due - n * 200000) OVER (PARTITION BY user_id ORDER BY due, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start FROM e",
    "fetch_tallies": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "ip_classes": f"WITH {values_sql('addresses')}, prefix(ord, version, low, high, kind) AS (VALUES {', '.join(f"({o}, {v}, '{a}', '{b}', '{k}')" for o, v, a, b, k in prefix_rows())}), a AS (SELECT ip, list_reduce(list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)), lambda s, x: s * 256 + x) AS v FROM addresses), k AS (SELECT ip, lpad(lower(to_hex(v)), 32, '0') AS key FROM a), c AS (SELECT ip, arg_min(kind, ord) AS ip_class FROM k JOIN prefix ON version = 4 AND key BETWEEN low AND high GROUP BY ip) SELECT ip, ip_class, ip_class IN ('public', 'loopback', 'private', 'link-local', 'shared') AS private_ok FROM c",
    "worst_by_group": f"WITH {doc_findings()}, {RULE} SELECT grp, count(*) AS n, arg_max(severity_name, severity) AS severity_name FROM found JOIN rule USING (id) GROUP BY grp",
    "severity_overrides": f"WITH {doc_findings()}, {RULE}, f AS (SELECT id, CASE id WHEN 'SEO-CONTENT-002' THEN 'high' WHEN 'WEB-HYGIENE-001' THEN 'info' ELSE severity_name END AS severity_name FROM found JOIN rule USING (id)) SELECT id, severity_name, count(*) AS n FROM f WHERE severity_name <> 'info' GROUP BY ALL",
    "audit_findings": f"WITH {RULE}, want(id, url) AS (VALUES {', '.join(f"('{i}', '{u}')" for i, u in expected())}) SELECT id, severity_name, url, count(*) AS n FROM want JOIN rule USING (id) GROUP BY ALL",
    "redirect_chains": f"""WITH RECURSIVE {values_sql("hops")}, start(url) AS (SELECT url FROM hops UNION ALL SELECT 'https://s.test/unknown'),
walk(url, place, n, path, status, error, final) AS (SELECT url, url, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS INTEGER), '', false FROM start
UNION ALL SELECT w.url, CASE WHEN moves AND NOT bad THEN target ELSE place END, CASE WHEN moves THEN n + 1 ELSE n END, list_append(path, place), CASE WHEN moves AND NOT bad OR over OR again THEN NULL ELSE h.status END,
  CASE WHEN over THEN 'too many redirects' WHEN again THEN 'redirect loop' WHEN h.url IS NULL THEN 'not stored' WHEN moves AND bad THEN 'invalid redirect' WHEN moves THEN '' ELSE h.error END, NOT moves OR bad
  FROM (SELECT *, n > 10 AS over, list_contains(path, place) AS again FROM walk WHERE NOT final) w LEFT JOIN hops h ON h.url = w.place,
  LATERAL (SELECT coalesce(h.status IN (301, 302, 303, 307, 308) AND h.location <> '' AND NOT over AND NOT again, false) AS moves, CASE WHEN h.location LIKE '/%' THEN 'https://s.test' || h.location ELSE h.location END AS target, coalesce(h.location LIKE 'ftp:%', false) AS bad) x)
SELECT url, place AS final_url, status, n AS redirects, error FROM walk WHERE final""",
    "host_verdicts": f"""WITH {values_sql("resolved")}, prefix(ord, version, low, high, kind) AS (VALUES {", ".join(f"({o}, {v}, '{a}', '{b}', '{k}')" for o, v, a, b, k in prefix_rows())}),
a AS (SELECT host, lpad(lower(to_hex(list_reduce(list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)), lambda s, x: s * 256 + x))), 32, '0') AS key FROM resolved WHERE ip IS NOT NULL),
c AS (SELECT host, key, arg_min(kind, ord) AS kind FROM a JOIN prefix ON version = 4 AND key BETWEEN low AND high GROUP BY ALL),
b AS (SELECT host, kind FROM c WHERE kind <> 'public' UNION ALL SELECT host, 'loopback' FROM resolved WHERE regexp_matches(lower(host), '(^|[.])localhost[.]?$'))
SELECT r.host, min(kind) IS NULL AS permitted, min(kind) AS blocked_class FROM (SELECT DISTINCT host FROM resolved) r LEFT JOIN b USING (host) GROUP BY r.host""",
    "followed_links": f"WITH {LINKS} SELECT DISTINCT url AS source, target, CASE WHEN regexp_matches(lower(regexp_extract(target, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '[.]({'|'.join(RESOURCE_EXTENSIONS)})$') THEN 'HEAD' ELSE 'GET' END AS method FROM link",
    "audit_crawl": f"SELECT * FROM (VALUES {', '.join(f"('{what}', {n})" for what, n in site_crawl(40).items())}) AS t(what, n)",
    "error_kinds": f"WITH {values_sql('errors')} SELECT id, kind FROM errors",
}
