"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed one after the other into one bit vector of as many 64-bit
words as they need.  A rule's position i is a bit; ``*`` and ``**`` put a
self-loop on the bit before them (``*``: any byte but ``/``; ``**``: any byte).
The Shift-And step ``D = ((D << 1 | starts) & B[c]) | (D & L[c])`` moves every
rule on by one byte at once, for a whole batch of urls at once; a url matches
the rules whose last bit is set at its end.  The work is a step of numpy for each
byte of the batch's longest url, over the urls that are that long.

Site rules are held against host and path as they stand.  The other rules are
held against the canonical url: host without user, port and final dots,
punycode as Unicode, accents taken off and letters folded; path with the escapes
of plain characters undone, dot segments resolved and letters folded.

Cases: null urls and urls without ``://`` have an empty host and path and match
only globs of the empty string; very long urls just take more steps; repeated
rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ascii_lower, lean, slices


@dataclass(frozen=True)
class Rule:
    glob: str
    verdict: str
    name: str | None  # reported as the rule; None for the method's own
    rank: int


def site_rule(site: str, verdict: str) -> list[Rule]:
    """A host with all its subdomains, and a path prefix: ``example.net/en/``.  Longer sites win."""
    return [Rule(f"{lead}{site}**", verdict, site, 1000 + len(site)) for lead in ("", "*.")]


#: The contract's rules.
SITES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Topics that the method blocks where no site rule fits: as a part of a host or of a path between separators.
TOPICS = "casino poker gambling slots betting lottery viagra cialis porn xxx escort payday".split()
HOST_TOPICS = "adult bets pills spam".split()


def topic_rules(topics: list[str], host_topics: list[str] = ()) -> list[Rule]:
    """Globs over canonical urls, in which marks stand for separators: host parts between ``<``, path parts between ``/``
    (see ``canonical``)."""
    hosts = [f"**<{t}<**" for t in [*topics, *host_topics]]
    return [Rule(glob, "block", None, 10) for glob in [*hosts, *(f"**>**/{t}/**" for t in topics)]]


def default_rules() -> list[Rule]:
    return [r for site, verdict in SITES for r in site_rule(site, verdict)] + topic_rules(TOPICS, HOST_TOPICS)


def load_rules(rows: DataFrame, most: int = 100_000) -> list[Rule]:
    """Rules from a table (glob, verdict, name, rank); at most ``most``, for the automaton is in every worker."""
    found = rows.select("glob", "verdict", "name", "rank").orderBy(F.desc("rank"), "glob").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules")
    return [Rule(*r) for r in found]


def _plain(text: str) -> str:
    """Accents off, letters folded."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def canonical(host: str, path: str) -> str:
    """``<host parts<>/path parts/``: labels of the host, and after a label with hyphens its parts, each behind a ``<``;
    parts of the path each behind a ``/``.  User and port say nothing of a site's topic and are left out."""
    from urllib.parse import unquote

    name = host.rpartition("@")[2]
    name = name if name.startswith("[") else name.partition(":")[0]
    labels = []
    for label in name.rstrip(".").split("."):
        try:
            label = label.encode("ascii").decode("idna") if label.startswith("xn--") else label
        except UnicodeError:
            pass
        labels.append(_plain(label))
    parts = []
    for part in _plain(unquote(path)).split("/"):
        if part == "..":
            parts = parts[:-1]
        elif part != ".":
            parts.append(part)
    split = "<".join(label if "-" not in label else f"{label}<" + label.replace("-", "<") for label in labels)
    return f"<{split}<>" + "/" + "/".join(parts).replace("_", "/").replace("-", "/").replace(".", "/") + "/"


class WildcardAutomaton:
    """All globs in one multiword Shift-And vector.

    Each glob takes one bit for its start and one for each literal byte; bit 0 of a glob stands for
    "nothing read yet" and loops where the glob begins with a wildcard."""

    def __init__(self, globs: list[str]):
        symbols: list[int] = []  # the byte a bit is entered by; -1 at a glob's start
        loops: list[int] = []  # 0 none, 1 any but '/', 2 any
        first, last = [], []
        for glob in globs:
            first.append(len(symbols))
            symbols.append(-1)
            loops.append(0)
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    both = raw[i + 1 : i + 2] == b"*"
                    loops[-1] = max(loops[-1], 2 if both else 1)
                    i += 2 if both else 1
                    continue
                symbols.append(raw[i])
                loops.append(0)
                i += 1
            last.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // 64))
        self.first, self.last = first, last
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for i, (symbol, loop) in enumerate(zip(symbols, loops, strict=True)):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            if symbol >= 0:
                self.enter[symbol, word] |= bit
            if loop:
                self.stay[:, word] |= bit
                if loop == 1:
                    self.stay[ord("/"), word] &= ~bit
        for i in first:
            self.start[i // 64] |= np.uint64(1 << (i % 64))

    def run(self, urls: list[bytes]) -> np.ndarray:
        """(urls, globs) booleans: does the glob fit the whole url?"""
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-size, kind="stable")
        width = size[order]
        flat = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        at = np.concatenate([[0], np.cumsum(width)[:-1]]) if len(urls) else np.zeros(0, np.int64)
        state = np.repeat(self.start[None, :], len(urls), 0)
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(width[0]) if len(urls) else 0):
            live = int(np.searchsorted(-width, -step, "left"))  # urls longer than step come first
            byte, now = flat[at[:live] + step], state[:live]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:live] = (shifted & self.enter[byte]) | (now & self.stay[byte])
        out = np.zeros((len(urls), len(self.last)), bool)
        for k, i in enumerate(self.last):
            out[order, k] = (state[:, i // 64] >> np.uint64(i % 64)) & one != 0
        return out


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    parts = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1), F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(parts[0]), parts[1]


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow", url_col: str = "url", key_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict): the highest ranking rule that fits decides, else ``default``."""
    rules = sorted(rules or default_rules(), key=lambda r: -r.rank)
    globs = [r.glob for r in rules]
    verdicts, names, own = [r.verdict for r in rules], [r.name for r in rules], np.array([r.name is None for r in rules])

    def judged(batches):
        import pyarrow as pa

        automaton = WildcardAutomaton(globs)
        for batch in slices(batches, 2000):
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            both = [(h + p, canonical(h, p)) for h, p in zip(hosts, paths, strict=True)]
            given, plain = (automaton.run([urls[k].encode("utf-8", "surrogatepass") for urls in both]) for k in (0, 1))
            fits = np.where(own, plain, given)
            hit, best = fits.any(1), fits.argmax(1)
            rule = [names[k] if f else None for k, f in zip(best, hit, strict=True)]
            verdict = [verdicts[k] if f else default for k, f in zip(best, hit, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col(url_col))
    narrow = pages.select(F.col(key_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return narrow.mapInArrow(lean(judged), "page_id long, host string, path string, rule string, verdict string")
