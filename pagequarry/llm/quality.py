"""Quality classifier: interpolated modified Kneser-Ney over the bytes of trusted text.

Counting: each task counts the n-grams (``ORDER`` bytes) of its trusted texts
and deals them to shards by the two bytes before the last; a shard adds up what
the tasks send, in as many rounds as keep each sum to ``FAN_IN`` parts or the tasks
of ``FOLD_BYTES``.  All n-grams and contexts of order 3 and more that a shard needs
end in those two bytes, so a shard derives its continuation counts and context
totals by itself.  Only figures of fixed size meet on the driver: four counts of
counts for each order (for the three discounts), and the table of byte pairs
(65,536 entries), from which orders 1 and 2 follow.

Scoring: a join at every size, in which neither model nor texts pass the driver.
Texts are packed into blocks of about ``BLOCK_BYTES``, written once, bucketed by
block.  A block asks each shard for its distinct n-grams; the questions meet the
shard's counts (join by shard) and the log-probabilities go back to the block
(join by block, for which the bucketed texts do not move).  An answer is a
half-precision number, off by one part in 2,000 at most.  Shards that many
blocks ask are copied, so that ``BLOCKS_AN_ANSWER`` blocks at most meet in one
group.  Perplexity is per byte; p_k = (c - D(c)) / total + gamma * p_(k-1).

Thresholds, by language, from trusted documents held out of training (one in
``HELD_OUT``, by hash of the text).  Short texts scatter more, so a document's
log-perplexity is taken as its distance from the language's median in units of
sqrt(1 / bytes + 1 / ``STEADY``); it is kept up to the 0.99 quantile of that,
and ``SLACK`` times the quantile beyond it.  Languages with fewer than
``LEAST_HELD`` of them take the figures of all; where all are fewer, nothing is
held out and the figures are those of all trusted documents.

Cases: null and empty texts have no perplexity and are rejected; a null language
is one more language; labels that repeat an id count once (quality 1 if any row
says so); without trusted text nothing but empty texts is rejected; NUL bytes
count as \\x01 (0 stands for "before the text"); where counts of counts are too
few for the estimate the discounts are 0.5, 0.75 and 0.9, and estimates are held
within 0.05 and the count; repeated rows score alike; columns of any name are
carried, and ``judge`` replaces those named like its results; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bucketed, discard, lean, materialize, slices, utf8_rows

ORDER, SLACK, HELD_OUT, LEAST_HELD, STEADY = 6, 0.15, 10, 20, 2400
CHUNK_BYTES, BLOCK_BYTES, SHARD_BYTES, MERGE_KEYS = 1 << 19, 5 << 20, 8 << 20, 1_000_000
MOST_SHARDS, BLOCKS_AN_ANSWER, BROADCAST_IDS = 65_521, 256, 2_000_000
#: Bytes of text whose tasks meet in one addition of counts, and how many sums meet in the next.
FOLD_BYTES, FAN_IN = 16 << 30, 256

_FREE_ZERO = bytes([1, *range(1, 256)])


# ---------------------------------------------------------------- n-grams


def chunks(raws: list[bytes]):
    """(first, raws) in runs of about CHUNK_BYTES."""
    start, size = 0, 0
    for i, raw in enumerate(raws):
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield start, raws[start : i + 1]
            start, size = i + 1, 0
    if start < len(raws):
        yield start, raws[start:]


def grams(raws: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ``order`` bytes ending at each byte of the texts, and where each text's keys end."""
    lead = bytes(order - 1)
    flat = np.frombuffer(b"".join(lead + raw.translate(_FREE_ZERO) for raw in raws), np.uint8)
    keys = np.zeros(len(flat), np.uint64)
    for back in range(order - 1, -1, -1):
        keys[back:] |= flat[: len(flat) - back].astype(np.uint64) << np.uint64(8 * back)
    return keys[flat != 0], np.cumsum([len(r) for r in raws])


def lowest(keys: np.ndarray, k: int) -> np.ndarray:
    """The last ``k`` bytes of n-grams."""
    return keys & np.uint64((1 << (8 * k)) - 1)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, with their counts added up."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=~keys[:1]) != 0]


def distinct_grams(raws: list[bytes], order: int) -> np.ndarray:
    parts = [distinct(grams(part, order)[0]) for _, part in chunks(raws)]
    return distinct(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def dealt(keys: np.ndarray, count: int) -> np.ndarray:
    """The shard of each n-gram, by the two bytes before its last."""
    return ((keys >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64) * 40503 % 65521 % count).astype(np.int32)


def by_shard(keys: np.ndarray, count: int):
    """(shard, positions of its keys) for every shard that has keys."""
    of = dealt(keys, count)
    order = np.argsort(of, kind="stable")
    shards, starts = np.unique(of[order], return_index=True)
    return list(zip(shards.tolist(), np.split(order, starts[1:]), strict=True)) if len(shards) else []


def planes(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, which compress well."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Rising keys by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw), dtype=np.uint64)


# ---------------------------------------------------------------- the model


def lowered(keys: np.ndarray, counts: np.ndarray, order: int, least: int = 3) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{k: (n-grams, counts)} from the highest order down to ``least``; below the highest, a count is that of the
    bytes that were seen before the n-gram."""
    tables = {order: (keys, counts)}
    for k in range(order - 1, least - 1, -1):
        low = lowest(tables[k + 1][0], k)
        tables[k] = added(low, np.ones(len(low), np.int64))
    return tables


def estimated_discounts(seen) -> list[float]:
    """D1, D2, D3+ from how many n-grams have the counts 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (int(n) for n in seen)
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def low_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


def taken_off(counts: np.ndarray, discounts: list[float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]


def pair_probabilities(pairs: np.ndarray) -> np.ndarray:
    """p of each second byte after each first one (65,536 numbers), from the pairs' counts."""
    after = (pairs > 0).sum(0)
    off = taken_off(after, estimated_discounts(low_counts(after)))
    single = (after - off) / max(1, after.sum()) + (off.sum() / after.sum() if after.sum() else 1.0) / 256
    off = taken_off(pairs, estimated_discounts(low_counts(pairs.ravel())))
    total = pairs.sum(1, keepdims=True)
    both = (pairs - off) / np.maximum(1, total) + off.sum(1, keepdims=True) / np.maximum(1, total) * single
    return np.where(total > 0, both, single).ravel()


class Model:
    """Counts dealt to shards (shard, keys, counts), and the figures of fixed size that all shards need."""

    def __init__(self, counts: DataFrame, order: int, shards: int, pairs: np.ndarray, discounts: dict[int, list[float]]):
        self.counts, self.order, self.shards, self.pairs, self.discounts = counts, order, shards, pairs, discounts


class Shard:
    """Probabilities of a shard's n-grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, pairs: np.ndarray, discounts: dict[int, list[float]]):
        self.order, self.pairs, self.tables = order, pairs, {}
        for k, (found, c) in lowered(keys, counts, order).items() if order > 2 else ():
            off = taken_off(c, discounts[k])
            contexts, at = np.unique(found >> np.uint64(8), return_inverse=True)
            total = np.bincount(at, c, len(contexts))
            self.tables[k] = found, (c - off) / total[at], contexts, np.bincount(at, off, len(contexts)) / total

    @staticmethod
    def _look_up(have: np.ndarray, values: np.ndarray, keys: np.ndarray, otherwise: float) -> np.ndarray:
        if not len(have):
            return np.full(len(keys), otherwise)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, values[at], otherwise)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        p = self.pairs[lowest(keys, 2).astype(np.int64)]
        for k in range(3, self.order + 1):
            found, own, contexts, gamma = self.tables[k]
            now = lowest(keys, k)
            # an unknown context leaves the lower order's p as it is
            p = self._look_up(found, own, now, 0.0) + self._look_up(contexts, gamma, now >> np.uint64(8), 1.0) * p
        return np.log(p)


def train(docs: DataFrame, order: int = ORDER, shards: int | None = None, shard_bytes: int = SHARD_BYTES, size: int | None = None, fold_bytes: int = FOLD_BYTES) -> Model:
    """The model of all texts of ``docs``, of about ``size`` bytes; by default a shard for every ``shard_bytes``."""
    if not 2 <= order <= 8:
        raise ValueError("an order from 2 to 8 is needed")
    if size is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or max(1, min(MOST_SHARDS, -(-size // shard_bytes)))
    folds = first_folds = max(1, -(-size // fold_bytes))

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fold = TaskContext.get().partitionId() % first_folds

        parts, held = [], 0
        for batch in slices(batches):
            for _, raws in chunks(utf8_rows(batch)):
                keys = grams(raws, order)[0]
                parts.append(added(keys, np.ones(len(keys), np.int64)))
                held += len(parts[-1][0])
                if held > MERGE_KEYS:
                    parts = [added(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                    held = 0
        if parts:
            keys, counts = added(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for shard, at in by_shard(keys, shards):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([fold], pa.int32()), pa.array([packed(keys[at])], pa.binary()), pa.array([planes(counts[at])], pa.binary())], ["shard", "fold", "keys", "counts"])

    def met(parts):
        return added(np.concatenate([unpacked(x.as_py()) for x in parts.column("keys")]), np.concatenate([from_planes(x.as_py()).astype(np.int64) for x in parts.column("counts")]))

    def join_parts(parts):
        import pyarrow as pa

        keys, counts = met(parts)
        row = parts.slice(0, 1)
        return pa.table([row.column("shard"), row.column("fold"), pa.array([packed(keys)], pa.binary()), pa.array([planes(counts)], pa.binary())], ["shard", "fold", "keys", "counts"])

    def add_up(parts):
        import pyarrow as pa

        keys, counts = met(parts)
        tables = lowered(keys, counts, order) if order > 2 else {}
        seen = [n for k in range(3, order + 1) for n in low_counts(tables[k][1])]
        after = lowest(tables[3][0], 2) if tables else keys
        pairs, n = added(after, np.ones(len(after), np.int64) if tables else counts)
        row = [parts.column("shard")[0].as_py()], [packed(keys)], [planes(counts)], [seen], [pairs.astype(np.int64).tolist()], [n.tolist()]
        kinds = pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())
        return pa.table([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["shard", "keys", "counts", "seen", "pairs", "n"])

    columns = "shard int, fold int, keys binary, counts binary"
    sent = docs.select("text").mapInArrow(lean(count), columns)
    while folds > 1:
        sent = materialize(sent.groupBy("shard", "fold").applyInArrow(join_parts, columns), "gram-parts")
        folds = -(-folds // FAN_IN)
        sent = sent.withColumn("fold", F.pmod("fold", F.lit(folds)).cast("int"))
    model = materialize(sent.groupBy("shard").applyInArrow(add_up, "shard int, keys binary, counts binary, seen array<long>, pairs array<long>, n array<long>"), "gram-counts")
    # Four numbers an order, and at most 65,536 byte pairs, whatever the text.
    seen = {r["pos"]: r["n"] for r in model.select(F.posexplode("seen").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}
    found = model.select(F.explode(F.arrays_zip("pairs", "n")).alias("p")).groupBy("p.pairs").agg(F.sum("p.n").alias("n")).collect()
    pairs = np.zeros(1 << 16, np.int64)
    for r in found:
        pairs[r["pairs"]] = r["n"]
    discounts = {k: estimated_discounts([seen.get(4 * (k - 3) + i, 0) for i in range(4)]) for k in range(3, order + 1)}
    return Model(model.select("shard", "keys", "counts"), order, shards, pair_probabilities(pairs.reshape(256, 256)), discounts)


# ---------------------------------------------------------------- scores


def boxed(batches, schema) -> bytes:
    """Rows as one compressed Arrow stream."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_table(pa.Table.from_batches(batches, schema).combine_chunks())
    return sink.getvalue().to_pybytes()


def unboxed(raw: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def texts_of(rows, text: str) -> list[bytes]:
    return [raw for batch in rows.to_batches() for raw in utf8_rows(batch, text)]


def with_scores(docs: DataFrame, model: Model, block_bytes: int = BLOCK_BYTES, precision: str = "float16", blocks_an_answer: int = BLOCKS_AN_ANSWER) -> DataFrame:
    """``docs`` with n_bytes and log_p as its last two columns."""
    order, shards, pairs, discounts = model.order, model.shards, model.pairs, model.discounts
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    text = inner[names.index("text")]
    rows = docs.toDF(*inner)

    def box(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        def block(held, number):
            return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()), pa.array([boxed(held, held[0].schema)], pa.binary())], ["block", "box"])

        held, size, number = [], 0, 0
        for batch in slices(batches):
            held.append(batch)
            size += batch.column(batch.schema.get_field_index(text)).nbytes
            if size >= block_bytes:
                yield block(held, number)
                held, size, number = [], 0, number + 1
        if held:
            yield block(held, number)

    blocks = bucketed(rows.mapInArrow(lean(box), "block long, box binary"), "block", "text-blocks")
    copies = max(1, -(-blocks.count() // blocks_an_answer))

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for block, box in zip(batch.column("block").to_pylist(), batch.column("box"), strict=True):
                keys = distinct_grams(texts_of(unboxed(box.as_py()), text), order)
                copy = (block * 2654435761 >> 16) % copies
                for shard, at in by_shard(keys, shards):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([copy], pa.int32()), pa.array([packed(keys[at])], pa.binary())], ["block", "shard", "copy", "asked"])

    def answer(questions, counts):
        import pyarrow as pa

        none = np.zeros(0, np.uint64)
        keys, times = (unpacked(counts.column("keys")[0].as_py()), from_planes(counts.column("counts")[0].as_py()).astype(np.int64)) if counts.num_rows else (none, none.astype(np.int64))
        own = Shard(keys, times, order, pairs, discounts) if questions.num_rows else None
        logs = [own.log_probabilities(unpacked(x.as_py())).astype(precision).tobytes() for x in questions.column("asked")]
        return pa.table([questions.column("block"), questions.column("shard"), pa.array(logs, pa.binary())], ["block", "shard", "logs"])

    asked = blocks.mapInArrow(lean(ask), "block long, shard int, copy int, asked binary")
    copied = model.counts.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    answers = asked.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInArrow(answer, "block long, shard int, logs binary")

    def total(block, answers):
        import pyarrow as pa

        if not block.num_rows:
            raise ValueError("answers for a block that is not there")
        table = unboxed(block.column("box")[0].as_py())
        raws = texts_of(table, text)
        keys, sums = distinct_grams(raws, order), np.zeros(len(raws))
        logs, found = np.full(len(keys), np.nan), dict(zip(answers.column("shard").to_pylist(), answers.column("logs"), strict=True))
        for shard, at in by_shard(keys, shards):
            logs[at] = np.frombuffer(found[shard].as_py(), precision)
        for first, part in chunks(raws):
            here, ends = grams(part, order)
            own, where = np.unique(here, return_inverse=True)
            run = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(keys, own)][where])])
            ends = np.concatenate([[0], ends])
            sums[first : first + len(part)] = run[ends[1:]] - run[ends[:-1]]
        return table.append_column("n_bytes", pa.array([len(r) for r in raws], pa.int64())).append_column("log_p", pa.array(sums, pa.float64()))

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, widened(rows, "n_bytes long, log_p double"))
    out = scored.toDF(*names, "n_bytes", "log_p")
    out.blocks = blocks  # for whoever is done with the result
    return out


def widened(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


# ---------------------------------------------------------------- verdicts


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that labels call good.  Ids are broadcast up to BROADCAST_IDS, else joined by a shuffle."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("good_id")).distinct()
    ids = materialize(ids, "trusted")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, F.col("doc_id") == F.col("good_id"), "left_semi")


def scatter(n_bytes):
    """How far texts of so many bytes lie from the median, up to a factor."""
    return F.sqrt(1 / n_bytes + 1 / F.lit(float(STEADY)))


def limits(known: DataFrame, least: int, slack: float) -> DataFrame:
    """(known_lang, middle, reach) for each language with ``least`` rows of ``known`` (lang, x, n), and (overall) one
    for all others."""
    exact = F.lit(10_000)
    middles = known.groupBy("lang").agg(F.percentile_approx("x", F.lit(0.5), exact).alias("middle"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    overall = F.lit(known.agg(F.percentile_approx("x", F.lit(0.5), exact).alias("middle")).first()["middle"])
    far = lambda middle: F.percentile_approx((F.col("x") - middle) / scatter(F.col("n")), F.lit(0.99), exact).alias("reach")
    own = known.join(middles.withColumnRenamed("lang", "known_lang"), F.col("lang").eqNullSafe(F.col("known_lang"))).groupBy("known_lang").agg(F.first("middle").alias("middle"), far(F.col("middle")))
    rest = known.agg(far(overall)).withColumn("middle", overall)  # one row
    both = own.select(F.lit(False).alias("overall"), "known_lang", "middle", "reach").union(rest.select(F.lit(True), F.lit(None).cast("string"), "middle", "reach"))
    return both.withColumn("reach", F.col("reach") + slack * F.abs("reach"))


def judged(docs: DataFrame, labels: DataFrame, order: int, slack: float) -> DataFrame:
    """The columns of ``docs`` under the names c0, c1.. with n_bytes, log_perplexity, threshold and keep."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    trusted = trusted_rows(docs.select("doc_id", "text", "lang"), labels)
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    size = F.octet_length("text")
    there = trusted.where(size > 0).agg(F.count(F.when(held, 1)).alias("held"), F.sum(size).alias("bytes")).first()
    apart = there["held"] >= LEAST_HELD
    if not there["bytes"]:
        sized = F.octet_length(F.coalesce(F.col(f"c{names.index('text')}"), F.lit(""))).cast("long")
        return inner.withColumn("n_bytes", sized).withColumn("log_perplexity", F.lit(None).cast("double")).withColumn("threshold", F.lit(None).cast("double")).withColumn("keep", F.col("n_bytes") > 0)
    model = train(trusted.where(~held) if apart else trusted, order, size=there["bytes"])
    sample = with_scores((trusted.where(held) if apart else trusted).select("lang", "text"), model)
    known = materialize(sample.where("n_bytes > 0").select("lang", (-F.col("log_p") / F.col("n_bytes")).alias("x"), F.col("n_bytes").alias("n")), "trusted-scores")
    discard(sample.blocks)
    table = materialize(limits(known, LEAST_HELD if apart else 1, slack), "limits")
    overall = table.where("overall").first()
    scored = with_scores(docs, model).toDF(*inner.columns, "n_bytes", "log_p")
    own = table.where("not overall").drop("overall")
    side = F.broadcast(own) if own.count() <= BROADCAST_IDS else own  # a row for each language
    joined = scored.join(side, F.col(f"c{names.index('lang')}").eqNullSafe(F.col("known_lang")), "left")
    limit = F.coalesce("middle", F.lit(overall["middle"])) + F.coalesce("reach", F.lit(overall["reach"])) * scatter(F.col("n_bytes"))
    full = F.col("n_bytes") > 0
    out = joined.withColumn("log_perplexity", F.when(full, -F.col("log_p") / F.col("n_bytes"))).withColumn("threshold", F.when(full, limit))
    return out.withColumn("keep", F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(False))).select(*inner.columns, "n_bytes", "log_perplexity", "threshold", "keep")


RESULTS = ("n_bytes", "log_perplexity", "threshold", "keep")


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, slack: float = SLACK) -> DataFrame:
    """``docs`` with n_bytes, log_perplexity (per byte), threshold and keep, instead of columns of those names."""
    out = judged(docs, labels, order, slack)
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in RESULTS]
    return out.select(*own, *RESULTS)


def good_documents(docs: DataFrame, labels: DataFrame, order: int = ORDER, slack: float = SLACK) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns as they are."""
    return judged(docs, labels, order, slack).where("keep").drop(*RESULTS).toDF(*docs.columns)
