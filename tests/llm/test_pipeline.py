"""run() against a brute-force composition on planted rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from pagequarry.llm import mixing
from test_llm_operators import water_filled


def test_run_matches_brute_force(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    texts = {i: " ".join(word() for _ in range(120)) for i in range(40)}
    clean = set(texts)
    texts |= {100: texts[1], 101: texts[1], 102: texts[2] + " tail"}
    texts |= {200 + i: "#$%&*!" * 60 + str(i) for i in range(3)}
    passage = " ".join(word() for _ in range(20))
    texts[300] = texts[5].replace(" ", "  ")[:200] + " " + " ".join(word() for _ in range(90)) + " " + passage
    source = {i: ["a", "b", None][i % 3] for i in texts}
    spark.createDataFrame([(i, t, "en", source[i], len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in clean], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = [r.asDict() for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()]

    size = {i: len(texts[i].split()) for i in clean}
    total = Counter()
    for i in clean:
        total[source[i]] += size[i]
    order = sorted(total, key=lambda s: (s is None, s))
    aim = dict(zip(order, water_filled([total[s] for s in order]), strict=True))
    want, at = Counter(), Counter()
    for i in sorted(clean, key=lambda i: hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()):
        s = source[i]
        copies = sum(at[s] + size[i] / 2 + k * total[s] <= aim[s] for k in (0, 1))
        at[s] += size[i]
        for _ in range(copies):
            want[i, len(texts[i].encode()) + 1, zlib.crc32(texts[i].encode())] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots, shard = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        shard[r["doc_id"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard.values())


NAMES = ["keep", "mix_id", "gone_id", "block", "text_key", "runs", "c0", "position", "limit_"]


def test_run_takes_odd_rows_and_columns(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = [(i, " ".join(word() for _ in range(60)), "en", ["a", None][i % 2], i) for i in range(40)]
    rows += [(None, " ".join(word() for _ in range(60)), None, "a", None), (None, None, None, None, None), (50, None, "en", "a", 1), (51, "", "en", "a", 1), (52, " \n", "de", "a", 1), rows[3], rows[3], (3, "another text under a used id " * 9, "en", "a", 1), (53, " ".join(word() for _ in range(30_000)), "en", "b", 1)]
    extra = tuple(f"{n}!" for n in NAMES)
    spark.createDataFrame([r + extra for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(40)] + [(None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(rows[7][1].split()[:20])), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    names, counts = docs.columns, [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == names, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        assert {tuple(r[n] for n in NAMES) for r in docs.collect()} == {extra}, name
    assert counts[0] > counts[1] > counts[2] > counts[3]
    out = corpus_pipeline.deal_shards(spark, docs, f"file://{tmp_path}").collect()
    assert len(out) == counts[4] and 7 not in {r["doc_id"] for r in out}


def test_run_takes_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
