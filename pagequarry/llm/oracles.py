"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import SEED
from .urlfilter import SITES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all({{}}, '{_WORD}')"

DECONTAMINATION = f"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i : i + least(13, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, row_number() OVER () AS r, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w, {_LOWER.format("coalesce(text, '')")} AS text FROM documents
), doc_window AS (
  SELECT r, n, i, w[i : i + n - 1] AS g
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)
), hit AS (
  SELECT r, i, n, item_id FROM doc_window JOIN item_window USING (n, g)
), word_hits AS (
  SELECT r, count(DISTINCT word) AS n_hit, min(word) AS head, max(word) AS tail FROM (SELECT r, unnest(range(i, i + n)) AS word FROM hit) GROUP BY r
), split AS (
  SELECT r, head, tail, w, string_split_regex(text, '{_WORD}') AS gap FROM doc JOIN word_hits USING (r)
), place AS (
  SELECT r, CAST(list_sum(list_transform(gap[1 : head], lambda x: strlen(x))) + coalesce(list_sum(list_transform(w[1 : head - 1], lambda x: strlen(x))), 0) AS BIGINT) AS hit_start,
    CAST(list_sum(list_transform(gap[1 : tail], lambda x: strlen(x))) + list_sum(list_transform(w[1 : tail], lambda x: strlen(x))) AS BIGINT) AS hit_end FROM split
), item_hits AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, hit_start, hit_end
FROM doc LEFT JOIN word_hits USING (r) LEFT JOIN item_hits USING (r) LEFT JOIN place USING (r)
"""

_RULES = ", ".join(f"('{site.partition('/')[0]}', '/{site.partition('/')[2]}', '{site}', '{verdict}')" for site, verdict in SITES)
#: What the method blocks of its own, in the words of SQL: a host with one of these topics in a label, or a path with one.
_TOPICS = "casino|poker|gambling|slots|betting|lottery|viagra|cialis|porn|xxx|escort|payday"
_PLAIN = f"regexp_replace(regexp_replace({_LOWER.format("regexp_replace(host, '^.*@', '')")}, ':[0-9]*$', ''), '[.]+$', '')"

URL_FILTER = f"""
WITH page AS (
  SELECT page_id, row_number() OVER () AS r,
    {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(site, lead, rule, verdict) AS (VALUES {_RULES}),
best AS (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM page JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, lead) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches({_PLAIN}, '(^|[.-])({_TOPICS}|adult|bets|pills|spam)([.-]|$)') OR regexp_matches(lower(path), '[/_.-]({_TOPICS})([/_.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM page LEFT JOIN best USING (r)
"""

LINE_DEDUP = f"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, r, i, ls[i] AS line, {_LOWER.format(f"trim(ls[i], {_SPACES})")} AS k FROM (SELECT doc_id, r, ls, unnest(range(1, len(ls) + 1)) AS i FROM doc)),
often AS (SELECT k, max(doc_id) AS last_doc FROM line WHERE length(k) >= 20 AND doc_id IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT line.*, coalesce(last_doc > doc_id, false) AS gone FROM line LEFT JOIN often USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

MIXING = f"""
WITH doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}') AS draw FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM doc GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][k % 3 + 1] AS w, [-0.5::DOUBLE, 0.0, 0.5][k % 3 + 1] AS tilt, 1.5::DOUBLE * sum(source_size) OVER () AS want FROM src
), ranked AS (
  SELECT *, row_number() OVER o AS place, want - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM weighed WINDOW o AS (ORDER BY source_size / w, k)
), level AS (
  SELECT min(place) AS place, arg_min(rest / heavy, place) AS level FROM ranked WHERE rest / heavy * w <= 2 * source_size
), plan AS (
  SELECT source AS named, source_size, tilt, CASE WHEN ranked.place < level.place THEN 2.0::DOUBLE * source_size ELSE level * w END AS target FROM ranked, level
), queued AS (
  SELECT doc_id, size, source_size, target, tilt,
    sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size + size / 2.0::DOUBLE AS middle
  FROM doc JOIN plan ON source IS NOT DISTINCT FROM named
), taken AS (
  SELECT *, size > 0 AND middle <= target AS one, size > 0 AND middle + source_size <= target AS two FROM queued
)
SELECT doc_id, size, source_size, target, CAST(size * (CAST(one AS INT) + CAST(two AS INT)) AS BIGINT) AS taken,
  round(CASE WHEN NOT one THEN NULL WHEN tilt = 0 THEN middle / target
    ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (middle / target)) - (1 - tilt)) / (2 * tilt) END, 6) AS position,
  round(CASE WHEN NOT two THEN NULL WHEN tilt = 0 THEN (middle + source_size) / target
    ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * ((middle + source_size) / target)) - (1 - tilt)) / (2 * tilt) END, 6) AS second_position
FROM taken
"""

WARC = """
WITH page AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
latest AS (SELECT payload_digest, max(page_id) AS last_id FROM page WHERE payload_bytes >= 1000 GROUP BY payload_digest),
judged AS (SELECT *, last_id IS NOT NULL AND page_id IS DISTINCT FROM last_id AS again FROM page LEFT JOIN latest USING (payload_digest))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN last_id END AS refers_to
FROM judged
"""

ORACLES = {
    "op2_decontamination": DECONTAMINATION,
    "op5_url_filter": URL_FILTER,
    "op6_line_dedup": LINE_DEDUP,
    "op8_mixing": MIXING,
    "op10_warc": WARC,
}
