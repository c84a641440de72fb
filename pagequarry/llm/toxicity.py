"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

Features of a text (eleven, all rates or counts that any language has):
densities and counts of lexicon words and of lexicon stems, lexicon words in the
reach of a second-person pronoun, lexicon words that only show after undoing
obfuscation, capitals, punctuation, digits inside words, symbol runs, length.
The lexicon is learned: the words and word beginnings whose document frequency
among toxic training rows most exceeds that among the others.

Fitting uses at most ``MAX_TRAIN`` labelled rows, drawn by a hash of the id, of
those that ``crc32(doc_id) mod 3`` does not hold out.  A fifth of them is kept
from the lexicon and the trees: it calibrates (pool adjacent violators).
Of rows that share an id the one with the smallest text hash is trained on.
Trees are grown on the driver (at most MAX_TRAIN x 11 numbers); scoring runs
over all documents.

Cases: null and empty texts are scored on zero features; a document without a
label is scored like any other; null labels are left out, of several for one id
the larger counts, labels above 0 are 1 and all others 0; with no labels, or labels of one
class only, every score is the share of label 1 (0.5 without any); repeated
rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean, materialize, slices, utf8_rows

FOLDS, HELD_OUT, MAX_TRAIN, CUT, MOST_TERMS = 3, 1, 24_000, 0.7, 500_000
LEXICON, MIN_TOXIC_DOCS, MIN_LOG_ODDS, STEMS = 3000, 4, 2.0, (4, 5, 6)
TREES, DEPTH, RATE, BIN_COUNT, MIN_LEAF, RIDGE = 60, 3, 0.2, 64, 20, 1.0

#: Second-person pronouns (English, German, French, Spanish, Italian, Portuguese).
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tuyo voi vostro você vocês seu sua".split())
#: Digits and signs that stand for letters in disguised words.
LEET = bytes.maketrans(b"0134578@$!|+", b"oieastbasiit")

_WORD = re.compile(rb"[^\x00-\x20]+")
_EDGE = b".,;:!?\"'()[]{}<>*#&%$|-_=+/\\~`^"
_UPPER = re.compile(rb"[A-Z]")
_PUNCT = re.compile(rb"[!-/:-@\[-`{-~]")
_MIXED = re.compile(rb"[A-Za-z][0-9@$!|*]+[A-Za-z]")
_RUNS = re.compile(rb"[!?*#$%&]{2,}")
NAMES = ["lexicon_share", "lexicon_count", "stem_share", "stem_count", "near_second_person", "disguised_share", "capital_share", "punctuation_share", "mixed_share", "symbol_run_share", "log_words"]


def plain_words(raw: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, without signs at their ends."""
    return [w for w in (x.strip(_EDGE) for x in raw.lower().split()) if w]


def stems(word: bytes) -> list[bytes]:
    """Word beginnings of STEMS bytes, marked so that they are no words."""
    return [word[:n] + b"*" for n in STEMS if len(word) > n]


def features(raw: bytes, words: frozenset, beginnings: frozenset) -> list[float]:
    plain = plain_words(raw)
    n = len(plain)
    if not n:
        return [0.0] * len(NAMES)
    hits = [i for i, w in enumerate(plain) if w in words]
    stem_hits = sum(1 for w in plain if len(w) > STEMS[0] and not beginnings.isdisjoint(stems(w)))
    near = sum(1 for i in hits if not SECOND_PERSON.isdisjoint(plain[max(0, i - 4) : i + 5]))
    mixed = _MIXED.findall(raw)
    disguised = sum(1 for w in plain if w not in words and w.translate(LEET, b"*.-_") in words) if mixed or b"*" in raw else 0
    size = len(raw)
    return [len(hits) / n, float(len(hits)), stem_hits / n, float(stem_hits), near / n, disguised / n, len(_UPPER.findall(raw)) / size, len(_PUNCT.findall(raw)) / size, len(mixed) / n, len(_RUNS.findall(raw)) / n, float(np.log1p(n))]


# ---------------------------------------------------------------- trees


class Boosted:
    """Binary log-loss boosting on binned features; a tree is (feature, threshold bin, left, right, value) arrays."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base, self.trees = edges, base, []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BIN_COUNT + 1)[1:-1])) for k in range(x.shape[1])]
        # Sparse counts: most rows are zero, so the quantiles of the others are added.
        edges = [np.unique(np.concatenate([e, [1e-12], np.quantile(x[x[:, k] > 0, k], np.linspace(0, 1, 17)) if (x[:, k] > 0).any() else []])) for k, e in enumerate(edges)]
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        model = cls(edges, float(np.log(share / (1 - share))))
        bins, margin = model.binned(x), np.full(len(y), model.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = model._grow(bins, y - p, p * (1 - p))
            model.trees.append(tree)
            margin += model._values(tree, bins)
        return model

    def _grow(self, bins, grad, hess):
        nodes: list[list] = []

        def grow(rows, depth):
            at = len(nodes)
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes.append([-1, 0, -1, -1, RATE * g / (h + RIDGE)])
            best = (1e-6, -1, 0)
            if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
                for k in range(bins.shape[1]):
                    column, size = bins[rows, k], len(self.edges[k]) + 1
                    gs, hs = np.bincount(column, grad[rows], size).cumsum()[:-1], np.bincount(column, hess[rows], size).cumsum()[:-1]
                    ns = np.bincount(column, minlength=size).cumsum()[:-1]
                    gain = gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - g**2 / (h + RIDGE)
                    gain[(ns < MIN_LEAF) | (len(rows) - ns < MIN_LEAF)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), k, int(gain.argmax()))
            if best[1] >= 0:
                left = bins[rows, best[1]] <= best[2]
                nodes[at][:2] = best[1:]
                nodes[at][2] = grow(rows[left], depth + 1)
                nodes[at][3] = grow(rows[~left], depth + 1)
            return at

        grow(np.arange(len(grad)), 0)
        return np.array(nodes, float)

    @staticmethod
    def _values(tree, bins):
        at = np.zeros(len(bins), int)
        for _ in range(DEPTH):
            feature = tree[at, 0].astype(int)
            inner = feature >= 0
            go = np.where(bins[np.arange(len(bins)), np.maximum(feature, 0)] <= tree[at, 1], tree[at, 2], tree[at, 3]).astype(int)
            at = np.where(inner, go, at)
        return tree[at, 4]

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return self.base + sum((self._values(t, bins) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the rising step fit by pool adjacent violators."""
    levels, at = np.unique(score, return_inverse=True)  # equal scores are one level
    blocks: list[list[float]] = []  # sum, count, least score, greatest score
    for level, total, count in zip(levels, np.bincount(at, y, len(levels)), np.bincount(at, minlength=len(levels)), strict=True):
        blocks.append([float(total), float(count), float(level), float(level)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    xs = [x for b in blocks for x in (b[2], b[3])]
    ys = [b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.array(xs), np.array(ys)


def calibrated(knots, margin: np.ndarray) -> np.ndarray:
    """Interpolated between the knots, with a sliver of the raw margin so that steps keep an order."""
    xs, ys = knots
    step = np.interp(margin, xs, ys) if len(xs) else np.full(len(margin), 0.5)
    return np.clip(0.999 * step + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


# ---------------------------------------------------------------- on Spark


def remainder(doc_id):
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS))


def train_rows(labels: DataFrame, target: str, most: int = MAX_TRAIN) -> list[tuple[int, int]]:
    """(doc_id, label) of at most ``most`` labelled rows outside the held-out fold."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (remainder(F.col("doc_id")) != HELD_OUT))
    one = own.groupBy("doc_id").agg(F.max((F.col(target) > 0).cast("int")).alias("y"))
    return [(r["doc_id"], int(r["y"])) for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


def calibrates(doc_id: int) -> bool:
    return zlib.crc32(f"calibrate {doc_id}".encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame):
    """(lexicon words, lexicon stems, trees, knots), or the share of label 1 where there is nothing to learn."""
    spark = docs.sparkSession
    picked = train_rows(labels, "toxic")
    ys = dict(picked)
    if len(set(ys.values())) < 2:
        return (sum(ys.values()) / len(ys)) if ys else 0.5
    chosen = spark.createDataFrame([(d, y, calibrates(d)) for d, y in picked], "train_id bigint, y int, hold boolean")
    # At most MAX_TRAIN rows of 13 bytes.
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(chosen), F.col("doc_id") == F.col("train_id"))
    least = materialize(labelled.groupBy(F.col("doc_id").alias("own_id")).agg(F.min("text_hash").alias("own_hash"), F.min("y").alias("own_y"), F.max("hold").alias("own_hold")), "labelled-rows")  # a row for each of them
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(least), (F.col("doc_id") == F.col("own_id")) & (F.xxhash64("text") == F.col("own_hash")))
    train = materialize(train.select("doc_id", "text", F.col("own_y").alias("y"), F.col("own_hold").alias("hold")).dropDuplicates(["doc_id"]), "labelled-texts")

    def terms(batches):
        import pyarrow as pa

        counts: dict[bytes, list[int]] = {}

        def told():
            kept = list(counts.items())
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.binary()), *(pa.array([c[k] for _, c in kept], pa.int64()) for k in (0, 1))], ["term", "clean", "toxic"])

        for batch in slices(batches):
            for raw, y in zip(utf8_rows(batch), batch.column("y").to_pylist(), strict=True):
                words = set(plain_words(raw))
                for t in words.union(s for w in words for s in stems(w)):
                    counts.setdefault(t, [0, 0])[y] += 1
                if len(counts) > MOST_TERMS:  # the sums go on in Spark
                    yield told()
                    counts.clear()
        yield told()

    seen = train.where("not hold").select("text", "y").mapInArrow(lean(terms), "term binary, clean long, toxic long")
    n1 = sum(1 for d, y in picked if y and not calibrates(d))
    n0 = sum(1 for d, y in picked if not y and not calibrates(d))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    ranked = seen.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= MIN_TOXIC_DOCS).withColumn("odds", odds)
    rows = ranked.where(F.col("odds") >= MIN_LOG_ODDS).orderBy(F.desc("odds"), "term").limit(LEXICON).collect()
    found = [bytes(r["term"]) for r in rows]
    words = frozenset(t for t in found if not t.endswith(b"*"))
    beginnings = frozenset(t for t in found if t.endswith(b"*"))
    seen_ids = {r["doc_id"]: r["x"] for r in feature_rows(train, words, beginnings).collect()}  # MAX_TRAIN rows at most
    ids = sorted(seen_ids)
    if len({ys[d] for d in ids}) < 2:
        return sum(ys.values()) / len(ys)
    x, y = np.array([seen_ids[d] for d in ids]), np.array([ys[d] for d in ids], float)
    hold = np.array([calibrates(d) for d in ids])
    if len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
        hold[:] = False
    model = Boosted.fit(x[~hold], y[~hold])
    checked = hold if hold.any() else ~hold
    return words, beginnings, model, isotonic(model.margin(x[checked]), y[checked])


def feature_rows(docs: DataFrame, words: frozenset, beginnings: frozenset) -> DataFrame:
    sets = docs.sparkSession.sparkContext.broadcast((words, beginnings))

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            xs = [features(raw, *sets.value) for raw in utf8_rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(xs, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, x array<double>")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out")
    if isinstance(model, float):
        return rows.select("doc_id", held, F.lit(model).alias("score"), F.lit(int(model >= CUT)).alias("predicted"))
    words, beginnings, trees, knots = model
    shared = docs.sparkSession.sparkContext.broadcast((words, beginnings, trees.edges, trees.base, trees.trees, knots))  # plain values only

    def run(batches):
        import pyarrow as pa

        words, beginnings, edges, base, grown, knots = shared.value
        trees = Boosted(edges, base)
        trees.trees = grown
        for batch in slices(batches):
            x = np.array([features(raw, words, beginnings) for raw in utf8_rows(batch)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(calibrated(knots, trees.margin(x)), pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
