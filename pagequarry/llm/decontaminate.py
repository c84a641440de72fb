"""Benchmark decontamination with one Aho-Corasick automaton.

Items and documents are normalised to word sequences (A-Z lower-cased; words
are runs of digits, letters and non-ASCII).  The items' windows of 13 words go,
as sequences of word numbers, into one automaton, which reads each document's
words once; hits are marked by word and mapped back to offsets of the original
text.  A Python worker builds the automaton once, from the items.  A megabyte of
items makes an automaton of about 135 MB, so items beyond ``MAX_ITEM_BYTES`` are
cut into blocks: the further automata read the texts too, but return only what
they hit, and their marks are joined to the documents before the first one runs.

Cases: null and empty texts have no words and no hits; items without words
match nothing; items of under 13 words are one window; equal windows of several
items count for each; rows that repeat an item_id are one item; a null item_id
is listed as an empty string; repeated documents are each reported; an empty
benchmark hits nothing; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean, materialize, slices

WINDOW, SHARE, MAX_ITEM_BYTES, BROADCAST_HITS = 13, 20, 1_000_000, 200_000
RESULTS = ("text", "n_words", "runs", "items", "spans")

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


def word_spans(raw: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the words in the original text."""
    import re

    return [m.span() for m in re.finditer(rb"[^\x20]+", raw.translate(_WORD_BYTES))]


class WindowAutomaton:
    """items: (item_id as text, UTF-8 text)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, raw in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(raw)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, owners in windows.items():
            self.automaton.add_word(key, (len(key), tuple(sorted(owners))))
        self.empty = not windows
        if windows:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs [start, end) of hit words, and the items that hit."""
        if self.empty or not words:
            return [], set()
        number = self.numbers.get
        runs: list[list[int]] = []
        items: set[str] = set()
        for end, (size, owners) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            start = end - size + 1
            items.update(owners)
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append([start, end + 1])
        return [(a, b) for a, b in runs], items


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(items: DataFrame, most: int) -> list[DataFrame]:
    """The distinct items (item_id as text, text) in blocks of about ``most`` bytes."""
    named = materialize(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).distinct(), "items")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))
    return [named] if n == 1 else [named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def built_once(key: str, build):
    """What ``build`` returns, kept by this worker process until another key is asked for."""
    import sys
    import types

    home = sys.modules.setdefault("pagequarry_worker", types.ModuleType("pagequarry_worker"))
    if getattr(home, "key", None) != key:
        home.key = home.value = None
        home.value = build()
        home.key = key
    return home.value


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """``docs`` (doc_id, text and others) with text as bytes, n_words, runs (hit words, start and end), items (sorted ids)
    and spans (the byte offsets of the runs in the original text), instead of columns of those names."""
    keys = [c for c in docs.columns if c.lower() not in RESULTS]
    pair = "array<struct<start:int,end:int>>"
    docs = docs.select(*keys, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    first, *others = [(block, docs.sparkSession.sparkContext.broadcast([(r["item_id"], bytes(r["text"])) for r in block.collect()])) for block in item_blocks(items.select("item_id", "text"), max_item_bytes)]
    if others:
        # The other automata read the texts too, but only report the texts that they hit.
        row = F.struct(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("text"))
        bare = docs.select(row.alias("row"), "text", F.lit(0).alias("n_words"), F.array().cast(pair).alias("runs"), F.array().cast("array<string>").alias("items"), F.array().cast(pair).alias("spans"))
        parts = [bare.mapInArrow(lean(scanner(listed, window, True)), bare.schema).select("row", "runs", "items") for _, listed in others]
        hits = materialize(reduce(DataFrame.union, parts).groupBy("row").agg(F.flatten(F.collect_set("runs")).alias("runs_"), F.flatten(F.collect_set("items")).alias("items_")), "item-hits")
        side = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
        docs = docs.join(side.withColumnRenamed("row", "row_"), row.eqNullSafe(F.col("row_")), "left").select(*docs.columns, "runs_", "items_")
        runs, known = F.coalesce("runs_", F.array().cast(pair)), F.coalesce("items_", F.array().cast("array<string>"))
    else:
        runs, known = F.array().cast(pair), F.array().cast("array<string>")
    docs = docs.select(*keys, "text", F.lit(0).alias("n_words"), runs.alias("runs"), known.alias("items"), F.array().cast(pair).alias("spans"))
    return docs.mapInArrow(lean(scanner(first[1], window, False)), docs.schema)


def scanner(listed, window: int, hits_only: bool):
    import uuid

    key = uuid.uuid4().hex

    def scan(batches):
        import pyarrow as pa

        automaton = built_once(key, lambda: WindowAutomaton(listed.value, window))
        for batch in slices(batches):
            raws = batch.column("text").to_pylist()
            counts, runs, items, where = [], [], [], []
            for raw, had, known in zip(raws, batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
                words = words_of(raw)
                got, owners = automaton.scan(words)
                both = union([*got, *((r["start"], r["end"]) for r in had)]) if had else got
                counts.append(len(words))
                runs.append([{"start": a, "end": b} for a, b in both])
                items.append(sorted(owners.union(known)))
                at = word_spans(raw) if both and not hits_only else []
                where.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in both] if at else [])
            named = {"n_words": counts, "runs": runs, "items": items, "spans": where}
            arrays = [pa.array(named[f.name], f.type) if f.name in named else batch.column(f.name) for f in batch.schema]
            out = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield out.filter(pa.array([bool(r) for r in runs], pa.bool_())) if hits_only else out

    return scan


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and where the first hit starts and the last one ends
    (bytes of the original text; null without hits)."""
    found = find_hits(docs.select("doc_id", "text"), items, **options)
    hit = F.aggregate("runs", F.lit(0), lambda acc, r: acc + r["end"] - r["start"])
    place = [F.get("spans", F.lit(0))["start"].cast("long").alias("hit_start"), F.try_element_at("spans", F.lit(-1))["end"].cast("long").alias("hit_end")]
    out = found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), *place)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hit_start", "hit_end")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """The documents that leak no item, whole and with all their columns.  A document leaks if hits make up one in
    ``SHARE`` of its words or more, or if a run of hits is as long as a window."""
    names = docs.columns
    inner = docs.toDF(*["doc_id" if c == "doc_id" else "text" if c == "text" else f"c{k}" for k, c in enumerate(names)])
    found = find_hits(inner.withColumn("no_text", F.col("text").isNull()), items, window, **options)
    hit = F.aggregate("runs", F.lit(0), lambda acc, r: acc + r["end"] - r["start"])
    long_run = F.exists("runs", lambda r: r["end"] - r["start"] >= window)
    kept = found.where(~(long_run | ((hit > 0) & (SHARE * hit >= F.col("n_words")))))
    return kept.select(*[F.when(~F.col("no_text"), F.decode("text", "UTF-8")).alias("text") if c == "text" else F.col(c) for c in inner.columns]).toDF(*names)
