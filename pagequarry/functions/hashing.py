"""FNV-1a, SimHash and Hamming distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSET_HIGH, OFFSET_LOW = 0xCBF29CE4, 0x84222325
PRIME_LOW, MASK = 435, 0xFFFFFFFF


def fnv1a(word: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes.  The hash is kept as two 32-bit halves, for long arithmetic overflows in ANSI mode:
    times 2**40 + 435 is (low * 435) plus, in the high half, high * 435 + low * 2**8 and the carry."""
    hexed = F.hex(F.encode(word, "UTF-8"))
    n = F.octet_length(word)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(OFFSET_HIGH).cast("long").alias("h"), F.lit(OFFSET_LOW).cast("long").alias("l"))

    def step(acc, i):
        byte = F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        low = acc["l"].bitwiseXOR(byte)
        product = low * PRIME_LOW
        high = acc["h"] * PRIME_LOW + F.shiftright(product, 32) + low * 256
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("h"), product.bitwiseAND(F.lit(MASK)).alias("l"))

    return F.aggregate(places, start, step, lambda acc: F.shiftleft(acc["h"], 32).bitwiseOR(acc["l"]))


def word_hashes(words) -> np.ndarray:
    """FNV-1a of an Arrow array of distinct words, all words a byte further at a time."""
    import pyarrow as pa

    raw = words.cast(pa.binary())
    size = np.array([len(w) for w in raw.to_pylist()], np.int64)
    flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    out = np.full(len(size), (OFFSET_HIGH << 32) + OFFSET_LOW, np.uint64)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[more] = (out[more] ^ flat[start[more] + k]) * np.uint64((1 << 40) + PRIME_LOW)
    return out


def token_simhash(docs: DataFrame, key: str, words: str) -> DataFrame:
    """(key, simhash) of each row's array of words; rows without words are left out.  A bit is set where fewer than half
    of the words' hashes have it.  One pass in Arrow batches: each distinct word of a batch is hashed once."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                lists = batch.column(1)
                sizes = np.array([len(x) for x in lists], np.int64)
                codes = lists.flatten().dictionary_encode()
                bits = np.unpackbits(word_hashes(codes.dictionary).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                at, ends, found = codes.indices.to_numpy(), np.cumsum(sizes), []
                for end, n in zip(ends, sizes, strict=True):
                    ones = np.zeros(64, np.int64)
                    for part in range(end - n, end, 65_536):
                        ones += bits[at[part : min(end, part + 65_536)]].sum(0, dtype=np.int64)
                    found.append(int(np.packbits(2 * ones < n, bitorder="little").view(np.int64)[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [key, "simhash"])

    rows = docs.select(key, F.col(words).alias("w")).where(F.size("w") > 0)
    return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, simhash long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
