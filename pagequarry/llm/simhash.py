"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints: a bit is 1 if it is set in over half of the XXH64 (seed 42)
hashes of the text's word shingles, repeats included.

Search: the 64 bits are grouped into parts, correlated bits together.  Two
fingerprints within ``tau`` bits agree to within ``t_i`` bits on some part i
whenever the ``t_i`` add up to ``tau - parts + 1`` (a part with -1 is skipped).
Dynamic programming over candidate counts estimated on a bounded sample picks
the ``t_i``; the sample only steers cost, never results.  Each distinct
fingerprint is filed under every value within ``t_i`` bits of its part i, and
files are verified.  A file of over ``FILE_LIMIT`` fingerprints is not compared
pairwise: its members are filed again under all 64-bit values within ``tau / 2``
bits of them, and two fingerprints lie within ``tau`` (even) exactly if they
share such a value.  Either way a file gives a spanning forest of its links, so
no link between components is lost and no group is spelled out in pairs.

``near_groups`` (the corpus pipeline's stage) answers for a Jaccard similarity
of 0.8 on five-word shingles.  There fingerprints of similar texts differ by 10
bits of 64 in the median and by up to 14, where every choice of parts files most
of the corpus together; so candidates come from bands of one-permutation MinHash
sketches, next to the fingerprints' own links.  Every pair that shares a band is
compared by its sketches, and those near the threshold by their shingle sets;
each group of texts that meet gives a spanning forest of its links.

Cases: null and empty texts have the fingerprint zero and link like any other;
texts of fewer words than a shingle are one shingle; repeated rows and equal
texts share a fingerprint; null ids never name a component while an id is there;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, lean, materialize, slices, utf8_rows

SAMPLE, FILE_LIMIT, BROADCAST_IDS = 2048, 256, 2_000_000
HASH_SEED = 42
#: near_groups: bins of a sketch, bands and bins of a band, texts of a block, and how far an estimate decides.
BINS, BANDS, ROWS, BLOCK, MARGIN = 512, 24, 7, 256, 0.08

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` space-joined words (fewer: of all of them)."""
    from xxhash import xxh64_intdigest

    words = raw.translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(text, HASH_SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    return np.fromiter((xxh64_intdigest(text[a:b], HASH_SEED) for a, b in zip(starts, stops[size - 1 :], strict=False)), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit, as a signed 64-bit number."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp)."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            fps = [fingerprint(shingle_hashes(raw, shingle)) for raw in utf8_rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, fp long")


# ---------------------------------------------------------------- parts and thresholds


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of near equal size, correlated bits together."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    if len(sample) > 1:
        centred = bits - bits.mean(0)
        spread = np.sqrt((centred**2).sum(0))
        spread[spread == 0] = np.inf
        tie = np.abs(centred.T @ centred / np.outer(spread, spread))
    else:
        tie = np.zeros((64, 64))
    free, out = list(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (tie[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds -1, 0, 1.. with the given sum at least cost; costs[i][t] for t = 0, 1..; -1 is free."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, picked) in best.items():
            for t in range(-1, len(row)):
                item = (cost + (row[t] if t >= 0 else 0.0), [*picked, t])
                if have + t not in new or item < new[have + t]:
                    new[have + t] = item
        best = new
    return best[total][1]


def plan_parts(sample: np.ndarray, rows: int, tau: int) -> list[tuple[list[int], int]]:
    """The cheapest (bits, threshold) parts over 1..tau + 2 parts."""
    found = []
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    scale = rows * max(0, rows - 1) / 2 / pairs
    upper = np.triu_indices(len(sample), 1)
    for parts in range(1, tau + 3):
        groups = grouped_bits(sample, parts)
        costs = []
        for bits in groups:
            apart = np.bitwise_count((sample[:, None] ^ sample[None, :]) & np.uint64(mask_of(bits)))[upper] if len(sample) > 1 else np.zeros(0, np.uint8)
            row = []
            for t in range(min(tau, 2) + 1):
                ball = sum(comb(len(bits), d) for d in range(t + 1))
                chance = pairs * min(1.0, ball / 2 ** len(bits))  # a sample sees no rare agreement
                row.append(((apart <= t).sum() + chance) * scale + 4.0 * rows * ball)
            costs.append(row)
        if not -parts <= tau - parts + 1 <= 2 * parts:
            continue
        thresholds = allocate(costs, tau - parts + 1)
        cost = sum(costs[i][t] for i, t in enumerate(thresholds) if t >= 0)
        found.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def flips(bits, radius: int) -> list[int]:
    """Masks of all ways to flip up to ``radius`` of the bits, as signed numbers."""
    return [signed(mask_of(c)) for d in range(radius + 1) for c in combinations(bits, d)]


def around(col, masks: list[int]):
    return F.explode(F.array(*[col.bitwiseXOR(F.lit(m).cast("long")) for m in masks]))


# ---------------------------------------------------------------- links


def forest(values: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (signed)."""
    near = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)[None, :]) <= tau
    left, out = np.ones(len(values), bool), []
    for i in range(len(values)):
        if not left[i]:
            continue
        left[i], queue = False, [i]
        while queue:
            at = queue.pop()
            for j in np.flatnonzero(near[at] & left).tolist():
                left[j] = False
                out.append((int(values[at]), int(values[j])))
                queue.append(j)
    return out


def links(nodes: DataFrame, tau: int = 2, file_limit: int = FILE_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``: a forest of each file, so the same components as all links."""
    if tau % 2:
        raise ValueError("an even distance is needed")
    rows = nodes.count()
    sample = np.array([r["fp"] for r in nodes.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts = plan_parts(sample, rows, tau) if rows else [(list(range(64)), tau)]
    filed = None
    for k, (bits, t) in enumerate(parts):
        value = F.col("fp").bitwiseAND(F.lit(signed(mask_of(bits))).cast("long"))
        one = nodes.select("fp", F.lit(k).alias("part"), around(value, flips(bits, t)).alias("value"))
        filed = one if filed is None else filed.union(one)
    filed = materialize(filed, "filed")
    sizes = filed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(filed.join(sizes, ["part", "value"]), "files")
    discard(filed)

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            found = [e for values in batch.column("fps") for e in forest(np.asarray(values.values, np.int64), tau)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    small = shared.where(F.col("n") <= file_limit).groupBy("part", "value").agg(F.collect_list("fp").alias("fps"))
    pairs = small.select("fps").mapInArrow(verify, "a long, b long")
    large = shared.where(F.col("n") > file_limit).select("fp").distinct()
    centres = large.select("fp", around(F.col("fp"), flips(range(64), tau // 2)).alias("centre"))
    met = centres.groupBy("centre").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # a ball's size at most
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.union(stars)


def label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id) of nodes (fp, first_id): the smallest first_id of the component."""
    roots = components(edges)
    joined = nodes.join(roots, nodes["fp"] == roots["node"])
    firsts = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    tied = joined.select("fp", "root").join(firsts, "root").select(F.col("fp").alias("node"), "component_id")
    return nodes.join(tied, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))


def simhash_groups(docs: DataFrame, shingle: int = 3, tau: int = 2, file_limit: int = FILE_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    named = materialize(label(nodes, links(nodes, tau, file_limit)), "named")  # so that a hot fingerprint's join can be split
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- groups by similarity


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash of a shingle set: each bin's least hash, empty bins filled from bins drawn at random.

    The draw for a bin is a fixed cycle through all bins (odd stride), so it ends and is the same for all texts."""
    out, have = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.sort(mixed ^ (mixed >> np.uint64(32)))
    where = (mixed >> np.uint64(64 - int(bins).bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-1) != 0)
    out[where[first]], have[where[first]] = mixed[first], True
    empty, step = np.flatnonzero(~have), 0
    while len(empty):
        step += 1
        draw = (empty * 40503 + step * (2 * empty + 1) * 7919) % bins
        filled = have[draw]
        out[empty[filled]] = out[draw[filled]]
        empty = empty[~filled]
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key, fp, sig, bands): hash of the text, fingerprint, the low four bits of each bin of the sketch, and
    a key for each band; texts without words have no bands."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in slices(batches):
            fps, sigs, keys = [], [], []
            for raw in utf8_rows(batch):
                hashes = shingle_hashes(raw, shingle)
                fps.append(fingerprint(hashes))
                full = sketch(hashes) if len(hashes) else np.zeros(0, np.uint64)
                low = (full & np.uint64(15)).astype(np.uint8)
                sigs.append((low[0::2] << 4 | low[1::2]).tobytes())
                packed, wide = full.tobytes(), 8 * ROWS
                keys.append([signed(xxh64_intdigest(packed[k * wide : (k + 1) * wide], k)) for k in range(BANDS if packed else 0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "fp", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(lean(run), "doc_id long, text_key long, fp long, sig binary, bands array<long>")


#: Of two bins in a byte, how many are zero.
_EQUAL_BINS = np.array([(b >> 4 == 0) + (b & 15 == 0) for b in range(256)], np.uint8)


def likeness(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated similarity of each sketch to one: equal bins, less those equal by chance."""
    return (_EQUAL_BINS[sigs ^ one].sum(1, dtype=np.int64) / BINS - 1 / 16) / (1 - 1 / 16)


def shared_part(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets, as sorted arrays."""
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


class FileComparison:
    """The texts of a file (or of two of its blocks) against each other: ``keys``, ``sigs`` (a row for each), and
    ``probe``: only pairs of a probing and another text are of interest; None: all."""

    def __init__(self, keys: np.ndarray, sigs: np.ndarray, probe: np.ndarray | None, similarity: float, margin: float):
        self.keys, self.sigs, self.probe = keys, sigs, probe
        self.low, self.least, self.high = similarity - margin, similarity, similarity + margin

    def candidates(self, at: int) -> np.ndarray:
        ok = np.ones(len(self.keys), bool) if self.probe is None else self.probe != self.probe[at]
        return ok & (self.keys != self.keys[at])

    def forest(self, sets: list[np.ndarray] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Edges of a spanning forest, and the number of each text's component.  Pairs are alike if their estimate is
        ``high`` or, given the shingle sets, if it is ``low`` and their similarity is enough."""
        component, edges = np.full(len(self.keys), -1), []
        for i in range(len(self.keys)):
            if component[i] >= 0:
                continue
            component[i], queue = i, [i]
            while queue:
                at = queue.pop()
                rest = np.flatnonzero(self.candidates(at) & (component < 0))
                near = likeness(self.sigs[rest], self.sigs[at])
                alike = near >= self.high
                if sets is not None:
                    for k in np.flatnonzero((near >= self.low) & ~alike).tolist():
                        alike[k] = shared_part(sets[at], sets[rest[k]]) >= self.least
                for j in rest[alike].tolist():
                    component[j] = i
                    edges.append((int(self.keys[at]), int(self.keys[j])))
                    queue.append(j)
        return edges, component

    def doubtful(self, component: np.ndarray) -> np.ndarray:
        """Texts of which some pair, not joined yet, has an estimate between ``low`` and ``high``."""
        out = np.zeros(len(self.keys), bool)
        for at in range(len(self.keys)):
            rest = np.flatnonzero(self.candidates(at) & (component != component[at]))
            out[at] = bool((likeness(self.sigs[rest], self.sigs[at]) >= self.low).any())
        return out


GROUP = ["band", "value", "i", "j"]


def by_group(batches, sizes=8192):
    """Tables of whole groups from batches sorted by GROUP."""
    import pyarrow as pa

    held, rows = [], 0

    def cut(table, last):
        columns = [table.column(c).to_numpy() for c in GROUP]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        starts = np.flatnonzero(new).tolist()
        stops = [*starts[1:], table.num_rows]
        ready = list(zip(starts, stops, strict=True))
        tail = None if last or not ready else table.slice(ready.pop()[0])
        return [table.slice(a, b - a) for a, b in ready], tail

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= sizes:
            done, tail = cut(pa.concat_tables(held).combine_chunks(), False)
            yield from done
            held, rows = [tail], tail.num_rows
    if rows:
        yield from cut(pa.concat_tables(held).combine_chunks(), True)[0]


def compared(met: DataFrame, similarity: float, margin: float) -> DataFrame:
    """``met`` (GROUP, text_key, probe, sig and, for the exact pass, hashes) group by group: links (a, b), and without
    hashes also the doubtful texts (GROUP, a; b is null)."""
    exact = "hashes" in met.columns

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        names = [*GROUP, "a", "b", "probe"]
        out = []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for group in by_group(batches):
            if group.num_rows < 2:
                continue
            keys = group.column("text_key").to_numpy()
            sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(keys), -1)
            probe = None if group.column("probe")[0].as_py() is None else group.column("probe").to_numpy(zero_copy_only=False).astype(bool)
            own = FileComparison(keys, sigs, probe, similarity, margin)
            sets = [np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()] if exact else None
            edges, component = own.forest(sets)
            out += [(None, None, None, None, a, b, None) for a, b in edges]
            if not exact:
                at = [group.column(c)[0].as_py() for c in GROUP]
                out += [(*at, int(keys[k]), None, None if probe is None else bool(probe[k])) for k in np.flatnonzero(own.doubtful(component)).tolist()]
            if len(out) > 20_000:
                yield rows()
                out = []
        if out:
            yield rows()

    dealt = met.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(lean(run), "band int, value long, i int, j int, a long, b long, probe boolean")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(key, hashes): the sorted distinct shingle hashes of the texts named in ``wanted`` (text_key, first_id)."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(raw, shingle)).tobytes() for raw in utf8_rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(sets, pa.binary())], ["key", "hashes"])

    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").join(side.withColumnRenamed("text_key", "wanted_key"), (F.col("text_key") == F.col("wanted_key")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    return own.select("text_key", "text").mapInArrow(lean(run), "key long, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough; two texts without words are alike."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            both = zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True)
            keep = [x == y or shared_part(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    hashes = sets.select("key", "hashes")
    joined = pairs.join(hashes.toDF("ka", "ha"), F.col("a") == F.col("ka")).join(hashes.toDF("kb", "hb"), F.col("b") == F.col("kb"))
    return joined.select("a", "b", "ha", "hb").mapInArrow(lean(run), "a long, b long")


def meetings(shared: DataFrame, sig: DataFrame, high: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(groups to compare, links found on the way) for the files ``shared`` (band, value, n, text_key).

    A file of up to ``block`` texts is one group.  In a larger one all texts first meet one of them, the pivot; those
    like it are linked to it and so to each other.  The others probe the whole file: blocks of them meet blocks of all
    texts, each two in a group of their own, so that no pair is left out and no task holds more than two blocks."""
    plain = lambda c, kind: F.lit(c).cast(kind)
    few = shared.where(F.col("n") <= block).select("band", "value", plain(0, "int").alias("i"), plain(0, "int").alias("j"), "text_key", plain(None, "boolean").alias("probe"))
    many = shared.where(F.col("n") > block)
    pivots = many.groupBy("band", "value").agg(F.min(F.struct(F.xxhash64("text_key", F.lit(1)).alias("h"), "text_key")).alias("p")).select(F.col("band").alias("b_"), F.col("value").alias("v_"), F.col("p.text_key").alias("pivot"))
    pivots = materialize(pivots.join(sig.toDF("k_", "pivot_sig"), F.col("pivot") == F.col("k_")).drop("k_"), "pivots")

    def star(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            own, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig", "pivot_sig"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("band", "value", "n", "text_key", "pivot")), pa.array(likeness(own, pivot) >= high)], ["band", "value", "n", "text_key", "pivot", "linked"])

    beside = many.join(sig.withColumnRenamed("text_key", "s_"), F.col("text_key") == F.col("s_")).join(pivots, (F.col("band") == F.col("b_")) & (F.col("value") == F.col("v_")))
    stars = materialize(beside.select("band", "value", "n", "text_key", "pivot", "sig", "pivot_sig").mapInArrow(lean(star), "band int, value long, n long, text_key long, pivot long, linked boolean"), "stars")
    found = stars.where("linked and text_key <> pivot").select(F.col("pivot").alias("a"), F.col("text_key").alias("b"))
    others = stars.where("not linked").groupBy("band", "value").agg(F.count(F.lit(1)).alias("m")).select(F.col("band").alias("b_"), F.col("value").alias("v_"), "m")
    rest = stars.join(others, (F.col("band") == F.col("b_")) & (F.col("value") == F.col("v_")))
    wide, tall = F.ceil(F.col("m") / block).cast("int"), F.ceil(F.col("n") / block).cast("int")
    number = lambda count, seed: F.pmod(F.xxhash64("text_key", F.lit(seed)), count).cast("int")
    probing = rest.where("not linked").select("band", "value", number(wide, 2).alias("i"), F.explode(F.sequence(F.lit(0), tall - 1)).alias("j"), "text_key", plain(True, "boolean").alias("probe"))
    probed = rest.select("band", "value", F.explode(F.sequence(F.lit(0), wide - 1)).alias("i"), number(tall, 3).alias("j"), "text_key", plain(False, "boolean").alias("probe"))
    return few.union(probing).union(probed), found


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tau: int = 2, block: int = BLOCK, margin: float = MARGIN) -> DataFrame:
    """(doc_id, text_key, root, component_id) of every row: groups linked by similar texts, repeated rows included; root
    is the least text hash of a group, component_id its least doc_id.

    Candidates share a band.  A pair's estimate has a standard error of 0.018 at 0.8; what lies further than
    ``margin`` (4.5 times that) from ``similarity`` is decided by the estimate, all other pairs by their shingle sets."""
    rows = materialize(sketches(docs, shingle), "sketches")
    nodes = materialize(rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("node_fp"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "sketch-nodes")
    filed = nodes.select("text_key", F.posexplode("bands").alias("band", "value"))
    mixed = F.xxhash64("text_key")
    files = filed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mixed).alias("x"), F.bit_xor(F.xxhash64(mixed)).alias("y")).where("n > 1")
    # Bands that file the same texts together need one look.
    files = files.groupBy("n", "x", "y").agg(F.min(F.struct("band", "value")).alias("f")).select("n", F.col("f.band").alias("b_"), F.col("f.value").alias("v_"))
    shared = materialize(filed.join(files, (F.col("band") == F.col("b_")) & (F.col("value") == F.col("v_"))).select("band", "value", "n", "text_key"), "sketch-files")
    sig = nodes.select("text_key", "sig")
    met, starred = meetings(shared, sig, similarity + margin, block)
    signed_rows = met.join(sig.toDF("s_", "sig"), F.col("text_key") == F.col("s_")).drop("s_")
    first = materialize(compared(signed_rows, similarity, margin), "compared")
    doubt = first.where("b is null").select(*GROUP, F.col("a").alias("text_key"), "probe")
    # The fingerprints' own links, carried over to texts: candidates like the others.
    by_fp = nodes.groupBy(F.col("node_fp").alias("fp")).agg(F.min("text_key").alias("head"))
    same = nodes.join(by_fp, F.col("node_fp") == F.col("fp")).where("text_key <> head").select(F.col("head").alias("a"), F.col("text_key").alias("b"))
    ends = by_fp.select(F.col("fp").alias("f"), "head")
    carried = links(by_fp.select("fp"), tau).join(ends.toDF("fa", "ha"), F.col("a") == F.col("fa")).join(ends.toDF("fb", "hb"), F.col("b") == F.col("fb")).select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    pairs = materialize(same.union(carried).distinct(), "fingerprint-pairs")
    unsure = doubt.select("text_key").union(pairs.select("a")).union(pairs.select("b")).distinct().toDF("d_")
    wanted = materialize(nodes.select("text_key", "first_id", "sig").join(unsure, F.col("text_key") == F.col("d_"), "left_semi"), "doubtful")
    sets = materialize(wanted.join(shingle_sets(docs, wanted.select("text_key", "first_id"), shingle), F.col("text_key") == F.col("key")).select("key", "sig", "hashes"), "shingle-sets")
    second = compared(doubt.join(sets, F.col("text_key") == F.col("key")).drop("key"), similarity, margin)
    alike = first.where("b is not null").select("a", "b").union(second.select("a", "b")).union(starred).union(verified(pairs, sets, similarity))
    roots = components(alike)
    rooted = materialize(nodes.join(roots, F.col("text_key") == F.col("node"), "left").select("text_key", "first_id", F.coalesce("root", "text_key").alias("root")), "near-roots")
    firsts = materialize(rooted.groupBy(F.col("root").alias("r_")).agg(F.min("first_id").alias("component_id")), "near-firsts")  # so that a hot root's join can be split
    named = materialize(rooted.join(firsts, F.col("root") == F.col("r_")).select(F.col("text_key").alias("t_"), "root", "component_id"), "near-named")
    found = materialize(rows.select("doc_id", "text_key").join(named, F.col("text_key") == F.col("t_")).select("doc_id", "text_key", "root", "component_id"), "near-groups")
    discard(rows, nodes, shared, first, pairs, wanted, sets, rooted, firsts, named)
    return found


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id (null last) and, among rows of one id, the
    smallest text hash; of rows equal in both, one.

    The rows that go are fewer than those that stay; up to BROADCAST_IDS of their keys are broadcast, else they are
    shuffled.  Columns of any name are carried."""
    names = docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own_id, own_text = F.col(f"c{names.index('doc_id')}").cast("long"), F.xxhash64(f"c{names.index('text')}")
    groups = near_groups(docs.select("doc_id", "text"), **options)
    rows = materialize(groups.groupBy("doc_id", "text_key").agg(F.first("root").alias("root"), F.count(F.lit(1)).alias("n")), "near-rows")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    heads = materialize(rows.groupBy(F.col("root").alias("r_")).agg(F.min(rank).alias("head")), "near-heads")
    judged = materialize(rows.join(heads, F.col("root") == F.col("r_")).withColumn("stays", rank == F.col("head")).where("not stays or n > 1").select("doc_id", "text_key", "stays"), "near-judged")
    discard(groups, rows, heads)

    def side(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys

    match = own_id.eqNullSafe(F.col("doc_id")) & (own_text == F.col("text_key"))
    kept = inner.join(side(judged.where("not stays").select("doc_id", "text_key")), match, "left_anti")
    again = judged.where("stays").select("doc_id", "text_key")  # rows that are there more than once
    if again.limit(1).count():
        several = kept.withColumn("id_", own_id).withColumn("text_", own_text).join(side(again), match, "left_semi")
        kept = kept.join(side(again), match, "left_anti").union(several.dropDuplicates(["id_", "text_"]).drop("id_", "text_"))
    return kept.toDF(*names)
