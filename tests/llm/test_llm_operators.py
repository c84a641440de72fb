"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import base64
import gzip
import hashlib
import io
import json
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagequarry.llm import decontaminate, fingerprints, linededup, mixing, quality, sharding, simhash, toxicity, urlfilter, warczip

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega ñandú über café".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def ascii_lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def sample_texts(n=60, seed=5):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    texts[3] = None
    texts[4] = ""
    texts[5] = " \t\n "
    texts[6] = texts[7] = texts[8]
    texts[9] = "one two"
    texts[10] = texts[11].upper()
    texts[12] = " ".join(rng.choice(WORDS) for _ in range(30_000))
    texts[13] = texts[14] + " tail"
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = sample_texts()
    rows = [(i * 3, t, ["en", "de", None][i % 3], ["a", "B", None, "z"][i % 4], None, "x") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (6, "another text under a used id", "en", "a", 1, "y")]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- 1


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_fingerprints_follow_jaccard_and_the_edit(docs, none):
    rows, df = docs
    keyed = defaultdict(int)
    for r in rows:
        keyed[r[0], r[1] or ""] += 1
    order = sorted(keyed, key=lambda k: (k[0], xxh_signed(k[1])))
    out = defaultdict(list)
    for r in got(fingerprints.edited_likeness(df)):
        out[r["doc_id"]].append(r)
    assert sum(map(len, out.values())) == len(rows)
    errors = []
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        mine = [r for r in out[doc_id] if r["edited_sha256"] == sha]
        assert len(mine) >= keyed[doc_id, text]
        for r in mine:
            assert r["n_chars"] == len(text)
            errors += [r["near_edited"] - jaccard(shingles(text), shingles(edited)), r["near_next"] - jaccard(shingles(text), shingles(after))]
            assert len(r["fingerprint"]) == (256 if text.split() else 0)
    # Texts of a few shingles may have two in one bin, of which one is lost.
    assert np.quantile(np.abs(errors), 0.95) < 0.12 and np.abs(np.mean(errors)) < 0.02
    assert got(fingerprints.edited_likeness(none)) == []


def xxh_signed(text):
    v = xxhash.xxh64_intdigest(text.encode(), 42)
    return v - 2**64 if v >= 2**63 else v


def test_densification_matches_a_plain_walk(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate([1, 5, 6, 9, 40, 300, 2000])], "doc_id long, text string")
    for r in fingerprints.with_fingerprint(df, "text", "fp").collect():
        w = [xxh_signed(x) for x in r["text"].split()]
        if len(w) < 5:
            hashes = [xxh_signed(" ".join(r["text"].split()))]
        else:
            hashes = [rolled(w[i : i + 5]) for i in range(len(w) - 4)]
        bins = {}
        for h in hashes:
            b = (h >> 56) + 128
            bins[b] = min(bins.get(b, h), h)
        want = []
        for i in range(256):
            t = 0
            if i not in bins:
                while (73 * i + 29 * (2 * i + 1) * t) % 256 not in bins:
                    t += 1
                want.append(bins[(73 * i + 29 * (2 * i + 1) * t) % 256] & 15)
            else:
                want.append(bins[i] & 15)
        assert r["fp"] == "".join(f"{x:x}" for x in want)


def rolled(values):
    """Spark's xxhash64 of several longs: each is hashed with the last result as seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >= 2**63 else seed


# ---------------------------------------------------------------- 2


def plain_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def word_places(text):
    import re

    return [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode())]


def test_decontamination_matches_brute_force(spark, docs, none):
    rows, df = docs
    long_text = next(r[1] for r in rows if r[0] == 36)
    items = [(1, " ".join(long_text.split()[100:130])), (2, "one two"), (3, None), (10, "tail"), (4, ""), (2, "one two"), (5, " ".join(long_text.split()[105:140]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.MAX_ITEM_BYTES, 200):
        out = got(decontaminate.contamination(df, bench, max_item_bytes=limit))
        assert len(out) == len(rows)
        want = Counter()
        for doc_id, text, *_ in rows:
            w, hit, ids, at = plain_words(text), set(), set(), word_places(text)
            for item, t in items:
                iw = plain_words(t)
                n = min(13, len(iw))
                windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
                for i in range(len(w) - n + 1 if n else 0):
                    if tuple(w[i : i + n]) in windows:
                        hit.update(range(i, i + n))
                        ids.add(str(item))
            want[doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), at[min(hit)][0] if hit else None, at[max(hit)][1] if hit else None] += 1
        assert Counter(tuple(r.values()) for r in out) == want
    assert got(decontaminate.contamination(none, bench)) == []
    assert not any(r["n_hit"] for r in got(decontaminate.contamination(df, bench.limit(0))))


def test_spans_point_into_the_original(spark):
    text = "Say: ONE, two é three! four"
    df = spark.createDataFrame([(1, text, "keep")], "doc_id long, text string, runs string").withColumnRenamed("runs", "other")
    bench = spark.createDataFrame([(7, "two é three")], "item_id long, text string")
    r = decontaminate.find_hits(df, bench).first()
    assert [text.encode()[s["start"] : s["end"]].decode() for s in r["spans"]] == ["two é three"] and r["items"] == ["7"] and r["other"] == "keep"


def test_clean_documents_keep_their_columns(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    df = spark.createDataFrame([(1, "x " * 900 + passage, "a"), (2, "nothing here", "b"), (3, None, "c")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = decontaminate.clean_documents(df, bench)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(2, "nothing here", "b"), (3, None, "c")]
    odd = df.withColumns({c: F.lit(c) for c in ("n_words", "runs", "spans", "c0", "no_text", "row", "runs_")})
    for limit in (decontaminate.MAX_ITEM_BYTES, 20):
        again = decontaminate.clean_documents(odd, bench, max_item_bytes=limit)
        assert again.columns == odd.columns and sorted((r["doc_id"], r["runs"], r["no_text"]) for r in again.collect()) == [(2, "runs", "no_text"), (3, "runs", "no_text")]


# ---------------------------------------------------------------- 3


def kneser_ney(texts, order):
    """log2-free reference: dict of counts, recursive interpolation."""
    counts = {order: Counter()}
    for t in texts:
        raw = [0] * (order - 1) + [b or 1 for b in (t or "").encode()]
        counts[order].update(tuple(raw[i : i + order]) for i in range(len(raw) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, ctx = {}, {}
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            disc[k] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]
        else:
            disc[k] = [0.5, 0.75, 0.9]
        ctx[k] = defaultdict(lambda: [0, 0.0])
        for g, c in counts[k].items():
            ctx[k][g[:-1]][0] += c
            ctx[k][g[:-1]][1] += disc[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        if g[:-1] not in ctx[k]:
            return p(g[1:])
        total, taken = ctx[k][g[:-1]]
        c = counts[k].get(g, 0)
        return (c - disc[k][min(c, 3) - 1] if c else 0) / total + taken / total * p(g[1:])

    def score(t):
        raw = [0] * (order - 1) + [b or 1 for b in (t or "").encode()]
        return sum(np.log(p(tuple(raw[i : i + order]))) for i in range(len(raw) - order + 1))

    return score


def test_language_model_matches_reference_and_shards_agree(spark, monkeypatch):
    texts = [t for t in sample_texts(30) if t is None or len(t) < 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    score = kneser_ney(texts[:15], 3)
    monkeypatch.setattr(quality, "FAN_IN", 2)
    for shards, fold_bytes in ((1, quality.FOLD_BYTES), (7, 1000)):
        model = quality.train(df.where("doc_id < 15").repartition(9), 3, shards, fold_bytes=fold_bytes)
        assert model.counts.count() > shards // 2
        for precision, near in (("float64", 1e-9), ("float16", 1e-3)):
            out = {r["doc_id"]: r for r in quality.with_scores(df, model, precision=precision).collect()}
            for i, t in enumerate(texts):
                assert out[i]["n_bytes"] == len((t or "").encode())
                assert out[i]["log_p"] == pytest.approx(score(t), rel=near, abs=near)


def test_judge_rejects_noise_and_keeps_the_rest(spark, docs, none):
    rows, df = docs
    noise = spark.createDataFrame([(9000 + i, "#$%&" * 50 + str(i), "en", "a", None, "n") for i in range(3)], SCHEMA)
    labels = spark.createDataFrame([(r[0], 1) for r in rows if r[0] % 2 == 0] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = got(quality.judge(df.union(noise), labels))
    assert len(out) == len(rows) + 3
    assert not any(r["keep"] for r in out if r["doc_id"] >= 9000)
    assert all(r["keep"] for r in out if r["doc_id"] < 9000 and len(r["text"] or "") > 40 and r["doc_id"] % 2 == 0)
    assert not any(r["keep"] for r in out if not r["text"])
    assert got(quality.judge(none, labels)) == []
    assert all(r["keep"] == bool(r["text"]) for r in got(quality.judge(df, labels.limit(0))))


@pytest.mark.parametrize("order", [2, 4, 8])
def test_scores_are_joined_and_the_model_is_not_fetched(spark, monkeypatch, order):
    texts = [t for t in sample_texts(30) if t is None or len(t) < 2000] + ["ñandú über café " * 3, "\U0001f600 été"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(15)] + [(len(texts) - 1, 1)], "doc_id long, quality int")
    score = kneser_ney([*texts[:15], texts[-1]], order)
    monkeypatch.setattr(type(df), "toArrow", lambda self: pytest.fail("fetched"))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: pytest.fail("sent"))
    assert {r["doc_id"] for r in quality.judge(df, labels, order).collect()} == set(range(len(texts)))
    model = quality.train(df.join(labels, "doc_id", "left_semi"), order, shard_bytes=2000)
    assert model.shards > 1
    for r in quality.with_scores(df, model, block_bytes=3000, precision="float64", blocks_an_answer=2).collect():
        assert r["text"] == texts[r["doc_id"]] and r["log_p"] == pytest.approx(score(r["text"]), rel=1e-9, abs=1e-9)


def test_thresholds_and_verdicts_match_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randrange(3, 80))) for _ in range(500)]
    lang = [None if i % 9 == 0 else ["en", "de", "xx"][min(2, i % 5)] if i % 100 else "rare" for i in range(500)]
    rows = [(i, t, lang[i]) for i, t in enumerate(texts)] + [(900 + i, "#%" * 30 + str(i), "en") for i in range(5)] + [(990, None, "en"), (991, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(480)] + [(901, 0), (480, None), (None, 1)], "doc_id long, quality int")
    held = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64("text"), F.lit(quality.HELD_OUT)) == 0).collect() if r["doc_id"] < 480}
    score = kneser_ney([t for i, t in enumerate(texts[:480]) if i not in held], 4)
    x = {i: -score(t) / len(t.encode()) for i, t, _ in rows if t}
    scatter = lambda i: np.sqrt(1 / len(rows[i][1].encode()) + 1 / quality.STEADY)
    at = lambda v, q: sorted(v)[max(0, int(np.ceil(q * len(v))) - 1)]

    def limit(members):
        middle = at([x[i] for i in members], 0.5)
        reach = at([(x[i] - middle) / scatter(i) for i in members], 0.99)
        return middle, reach + quality.SLACK * abs(reach)

    groups = defaultdict(list)
    for i in held:
        groups[lang[i]].append(i)
    assert len(held) >= quality.LEAST_HELD and min(map(len, groups.values())) < quality.LEAST_HELD <= max(map(len, groups.values()))
    own = {g: limit(m) for g, m in groups.items() if len(m) >= quality.LEAST_HELD}
    overall = limit(held)
    out = {r["doc_id"]: r for r in quality.judge(docs, labels, 4).collect()}
    assert len(out) == len(rows)
    for k, (i, t, g) in enumerate(rows):
        if not t:
            assert out[i]["keep"] is False and out[i]["threshold"] is None
            continue
        middle, reach = own.get(g, overall)
        want = middle + reach * np.sqrt(1 / len(t.encode()) + 1 / quality.STEADY)
        assert out[i]["threshold"] == pytest.approx(want, rel=1e-3) and out[i]["log_perplexity"] == pytest.approx(x[i], rel=1e-3)
        assert abs(x[i] - want) < 0.005 or out[i]["keep"] == (x[i] <= want), k
    assert not any(out[900 + i]["keep"] for i in range(5))


def test_columns_of_any_name_pass_the_classifier(spark):
    names = ["n_bytes", "log_p", "threshold", "keep", "limit_", "block", "shard", "known_lang", "good_id", "c0", "reach"]
    docs = spark.createDataFrame([(i, f"some text of row {i}", "en", *[f"{n}{i}" for n in names]) for i in range(60)], ["doc_id", "text", "lang", *names])
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    rows = {tuple(r) for r in docs.collect()}
    got_rows = [tuple(r) for r in kept.collect()]
    assert len(got_rows) > 50 and set(got_rows) <= rows
    out = quality.judge(docs, labels)
    assert sorted(out.columns) == sorted(docs.columns + ["log_perplexity"]) and out.first()["keep"] in (True, False)
    assert quality.good_documents(docs.limit(0), labels).collect() == []


def test_language_model_grows_with_the_text(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeinrs") for _ in range(rng.randrange(3, 8)))
    texts = [" ".join(word() for _ in range(200)) for _ in range(100)]
    rows = [quality.train(spark.createDataFrame([(t,) for t in texts[:n]], "text string")).counts.agg(F.sum(F.octet_length("keys"))).first()[0] for n in (10, 100)]
    assert rows[1] > 3 * rows[0]


# ---------------------------------------------------------------- 4


def test_toxicity_learns_held_out_documents(spark, docs, none):
    rng = random.Random(2)
    rows, ys = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(40)]
        if toxic:
            words[rng.randrange(40)] = rng.choice(["grobling", "snotface", "dungwit"])
        rows.append((i, " ".join(words), "en", "s", None, "e"))
        ys.append((i, int(toxic)))
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([*ys, (None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in got(toxicity.score_documents(df, labels))}
    assert len(out) == 900
    for i, y in ys:
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= out[i]["score"] <= 1 and out[i]["predicted"] == (out[i]["score"] >= 0.7)
        if out[i]["held_out"]:
            assert out[i]["predicted"] == y
    # labels of the held-out fold change nothing
    flipped = spark.createDataFrame([(i, 1 - y if out[i]["held_out"] else y) for i, y in ys], "doc_id long, toxic int")
    assert {r["doc_id"]: r["score"] for r in got(toxicity.score_documents(df, flipped))} == {i: r["score"] for i, r in out.items()}
    _, odd = docs
    assert len(got(toxicity.score_documents(odd, labels.limit(0)))) == odd.count()
    assert {r["score"] for r in got(toxicity.score_documents(odd, labels.limit(0)))} == {0.5}
    assert got(toxicity.score_documents(none, labels)) == []


def test_odd_labels_and_repeated_ids(spark, monkeypatch):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(WORDS) for _ in range(20)] + (["grobling"] if i % 3 == 0 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, [2, 0, -1][i % 3]))
    hot = next(i for i in range(240) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows += [(hot, f"another text {k % 7}") for k in range(3000)]
    seen = []
    original = toxicity.feature_rows
    monkeypatch.setattr(toxicity, "feature_rows", lambda docs, *a: seen.append(docs.count()) or original(docs, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.score_documents(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) and seen == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(240))]
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in out if r["doc_id"] != hot and r["held_out"])


def test_features_count_whole_texts():
    words, beginnings = frozenset([b"bad"]), frozenset([b"grob*"])
    x = dict(zip(toxicity.NAMES, toxicity.features(b"Bad " * 300 + b"groblings b@d, you!! B4D", words, beginnings), strict=True))
    assert x["lexicon_count"] == 300 and x["stem_count"] == 1 and x["disguised_share"] == pytest.approx(2 / 304) and x["near_second_person"] == pytest.approx(2 / 304)
    assert x["symbol_run_share"] == pytest.approx(1 / 304) and x["log_words"] == pytest.approx(np.log1p(304))
    assert toxicity.features(b" \n", words, beginnings) == [0.0] * 11


def brute_tree(x, grad, hess, edges, depth):
    """The best splits by trying every threshold of every feature; leaves are values."""
    g, h = grad.sum(), hess.sum()
    best = (1e-6, None)
    if depth and len(x) >= 2 * toxicity.MIN_LEAF:
        for k in range(x.shape[1]):
            for cut in edges[k]:
                left = x[:, k] < cut
                if min(left.sum(), (~left).sum()) < toxicity.MIN_LEAF:
                    continue
                part = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + toxicity.RIDGE)
                gain = part(left) + part(~left) - g**2 / (h + toxicity.RIDGE)
                if gain > best[0] + 1e-12:
                    best = (gain, (k, cut))
    if best[1] is None:
        return toxicity.RATE * g / (h + toxicity.RIDGE)
    left = x[:, best[1][0]] < best[1][1]
    return best[1], brute_tree(x[left], grad[left], hess[left], edges, depth - 1), brute_tree(x[~left], grad[~left], hess[~left], edges, depth - 1)


def fall(tree, row):
    while isinstance(tree, tuple):
        (k, cut), low, high = tree
        tree = low if row[k] < cut else high
    return tree


def test_boosting_matches_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 4)
    monkeypatch.setattr(toxicity, "MIN_LEAF", 5)
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=160), rng.integers(0, 4, 160).astype(float), np.where(rng.random(160) < 0.8, 0, rng.random(160))], 1)
    y = (x[:, 0] + x[:, 1] + 3 * x[:, 2] + rng.normal(size=160) > 2).astype(float)
    model = toxicity.Boosted.fit(x, y)
    margin = np.full(160, np.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        tree = brute_tree(x, y - p, p * (1 - p), model.edges, toxicity.DEPTH)
        margin = margin + np.array([fall(tree, row) for row in x])
    assert np.allclose(model.margin(x), margin)


def test_isotonic_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        score = rng.integers(0, 12, 25).astype(float)
        y = (rng.random(25) < score / 12).astype(float)
        order = np.argsort(score, kind="stable")
        levels = sorted(set(score))
        sums = [(y[score == v].sum(), (score == v).sum()) for v in levels]
        mean = lambda a, b: sum(s for s, _ in sums[a:b]) / sum(n for _, n in sums[a:b])
        want = {v: max(min(mean(a, b) for b in range(i + 1, len(levels) + 1)) for a in range(i + 1)) for i, v in enumerate(levels)}  # max-min formula
        xs, ys = toxicity.isotonic(score, y)
        assert np.allclose(np.interp(score[order], xs, ys), [want[v] for v in score[order]])
    xs, ys = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert list(ys) == sorted(ys) and list(toxicity.calibrated((xs, ys), np.array([1.0, 2.5, 5])) > [-1, 0.4, 0.9]) == [True] * 3


# ---------------------------------------------------------------- 5


def test_wildcard_automaton_matches_regex():
    import re

    rng = random.Random(3)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "."]) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    urls = ["".join(rng.choice("ab/.") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    fits = urlfilter.WildcardAutomaton(globs).run([u.encode() for u in urls])
    for k, g in enumerate(globs):
        pattern = re.compile("".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.findall(r"\*\*|\*|[^*]", g)), re.S)
        assert [bool(pattern.fullmatch(u)) for u in urls] == list(fits[:, k])


def test_url_rules(spark):
    cases = {
        "http://a.example.net/en/x": ("example.net/en/", "allow"),
        "http://example.net/de": ("net/", "block"),
        "HTTP://EXAMPLE.NET/en/#f": ("example.net/en/", "allow"),
        "http://net": (None, "allow"),
        "http://evil.org/a.net/": (None, "allow"),
        "http://x.org/fr/?q": ("org/fr/", "allow"),
        "https://m.example.com/de/": ("example.com/de/", "block"),
        "https://notexample.com/de/": (None, "allow"),
        "http://casino.test/x": (None, "block"),
        "https://www.spamhaus.test/": (None, "allow"),
        "http://www.gambling-slots.test/": (None, "block"),
        "https://Me@POKER.test.:443/": (None, "block"),
        "http://xn--pker-5qa.test/": (None, "block"),
        "http://p\u00f3ker.test/": (None, "block"),
        "http://xn--pker-sqa.test/": (None, "allow"),
        "http://h.test/a/%43asino/b": (None, "block"),
        "http://h.test/casino/../b": (None, "allow"),
        "http://h.test/occasion/adult": (None, "allow"),
        "http://casino.example.net/en/": ("example.net/en/", "allow"),
        "http://example.net:80/en/": (None, "allow"),
        "no scheme": (None, "allow"),
        None: (None, "allow"),
        "": (None, "allow"),
        "http://h.net/" + "a" * 5000: ("net/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "html", "x") for i, u in enumerate(cases)], "page_id long, url string, html string, host string")
    out = {r["page_id"]: r for r in got(urlfilter.judge_urls(pages))}
    for i, (u, (rule, verdict)) in enumerate(cases.items()):
        assert (out[i]["rule"], out[i]["verdict"]) == (rule, verdict), u
    assert got(urlfilter.judge_urls(pages.limit(0))) == []
    loaded = urlfilter.load_rules(spark.createDataFrame([("**h.test/a/*", "block", "mine", 5), ("**<poker<**", "block", None, 1)], "glob string, verdict string, name string, rank int"))
    out = {r["page_id"]: r["verdict"] for r in got(urlfilter.judge_urls(pages, loaded))}
    assert {u for i, u in enumerate(cases) if out[i] == "block"} == {u for u in cases if u and "test" in u and ("/a/%43" in u or "POKER" in u or "\u00f3" in u or "5qa" in u)} - {"http://h.test/a/%43asino/b"}


# ---------------------------------------------------------------- 6


def test_line_dedup_matches_brute_force(spark, none):
    rng = random.Random(4)
    pool = [f"a line that is long enough number {i}" for i in range(12)] + ["short", "  A LINE that is Long enough NUMBER 3 ", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))), "en", "s", None, "e") for i in range(40)]
    rows += [(100, None, "en", "s", None, "e"), (101, "", "en", "s", None, "e"), rows[5], (None, pool[0], "en", "s", None, "e")]
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 20:
                held[key(line)].add(d)
    want = Counter()
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if d is None or len(held[key(x)]) < 3 or max(held[key(x)]) == d]
        want[d, len(ls), len(ls) - len(keep), "\n".join(keep)] += 1
    for batches, fanout in ((None, 2), (1, 2), (7, 3)):
        out = linededup.dedup_lines(df, batches=batches, fanout=fanout)
        assert Counter((r["doc_id"], len(r["lines"]), r["n_dropped"], r["kept"]) for r in out.collect()) == want
    assert got(linededup.dedup_lines(none)) == []
    clash = df.toDF("doc_id", "text", "gone", "drop_id", "lines", "kept").withColumn("text_key", F.lit("t")).withColumn("c0", F.lit("c"))
    out = linededup.dedup_lines(clash)
    assert sorted(out.columns) == sorted([*clash.columns, "n_dropped"]) and {r["gone"] for r in out.collect()} == {"en"}
    assert Counter((r["doc_id"], len(r["lines"]), r["n_dropped"], r["kept"]) for r in out.collect()) == want


def test_every_batch_is_anti_joined_with_the_runs(spark, monkeypatch):
    looked = []
    unseen = linededup.LineRuns.unseen
    monkeypatch.setattr(linededup.LineRuns, "unseen", lambda self, lines: looked.append(len(self.runs())) or unseen(self, lines))
    line = lambda k: f"line number {k} of more than twenty"
    df = spark.createDataFrame([(i, "\n".join([line(i), line(i // 4), line(0)] * 3)) for i in range(200)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in linededup.dedup_lines(df, batches=6).collect()}
    assert looked == [0, 1, 1, 2, 1, 2]
    assert all(out[i]["n_dropped"] == (3 if i < 199 else 0) + (3 if 4 <= i < 199 and i % 4 != 3 else 0) for i in range(50, 199))


def test_runs_level_up_and_anti_join(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(bytearray(f"l{j}".encode()), k) for j in range(k, k + 3)], "line binary, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    seen = {bytes(r["line"]).decode(): (r["n_docs"], r["last_doc"]) for r in runs.repeated(1).collect()}
    assert seen["l2"] == (3, 2) and seen["l6"] == (1, 4)
    new = spark.createDataFrame([(bytearray(b"l2"),), (bytearray(b"l9"),)], "line binary")
    assert [bytes(r["line"]) for r in runs.unseen(new).collect()] == [b"l9"]


# ---------------------------------------------------------------- 7


def brute_components(fps, tau):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= tau:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_fingerprints_and_components(docs, none):
    rows, df = docs
    out = got(simhash.simhash_groups(df))
    assert len(out) == len(rows)
    by_text = {}
    for _, t, *_ in rows:
        w = ascii_lower(t or "").split()
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        by_text[t] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    want_fp = Counter((r[0], f"{by_text[r[1]]:016x}") for r in rows)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in out) == want_fp
    names = {f: min(r[0] for r in rows if by_text[r[1]] == f) for f in set(by_text.values())}
    comp = brute_components({names[f]: f for f in names}, 2)
    assert all(r["component_id"] == comp[names[int(r["fingerprint"], 16)]] for r in out)
    assert got(simhash.simhash_groups(none)) == []


@pytest.mark.parametrize("file_limit", [256, 3])
def test_links_lose_no_component(spark, file_limit):
    rng = random.Random(6)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(15):
            x = centre
            for _ in range(rng.randrange(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, first_id long")
    want = brute_components(dict(enumerate(fps)), 2)
    out = {r["fp"]: r["component_id"] for r in simhash.label(nodes, simhash.links(nodes, 2, file_limit)).collect()}
    assert out == {simhash.signed(f): want[i] for i, f in enumerate(fps)}


def test_part_plans_satisfy_the_pigeonhole():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 200, dtype=np.int64).view(np.uint64)
    for tau in (2, 4):
        parts = simhash.plan_parts(sample, 10_000, tau)
        flat = [b for bits, _ in parts for b in bits]
        assert len(flat) == len(set(flat))
        # any tau flipped bits leave some part within its threshold
        for _ in range(300):
            flipped = set(rng.choice(64, tau, replace=False).tolist())
            assert any(len(flipped & set(bits)) <= t for bits, t in parts)


def test_allocation_is_optimal():
    import itertools

    costs = [[5.0, 9.0], [1.0, 2.0], [4.0, 4.5]]
    picked = simhash.allocate(costs, 0)
    cost = lambda ts: sum(costs[i][t] for i, t in enumerate(ts) if t >= 0)
    assert cost(picked) == min(cost(t) for t in itertools.product((-1, 0, 1), repeat=3) if sum(t) == 0)


def near_components(texts, least=0.8):
    """Components of texts whose five-word shingle sets are alike, by comparing all pairs."""
    import itertools

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= least:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def test_near_groups_find_copies_and_spare_others(spark):
    rng = random.Random(8)
    rows, group = [], {}
    for g in range(12):
        base = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(150)]
        for c in range(6):
            words = list(base)
            if c > 1:
                words[rng.randrange(150)] = f"edit{c}"
            rows.append((g * 10 + c, " ".join(words), "en", "s", 1, "e"))
            group[g * 10 + c] = g * 10
    texts = {r[0]: r[1] for r in rows}
    rows += [(500, None, "en", "s", 1, "e"), (501, "", "en", "s", 1, "e"), (0, rows[0][1], "en", "s", 1, "e"), (None, "no id", "en", "s", 1, "e"), (None, "other words without id", "en", "s", 1, "e"), (0, "another text under a used id", "en", "s", 1, "e"), (None, texts[10], "en", "s", 1, "e")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df.where("doc_id < 500 and text not like 'another%'")).collect()}
    assert out == group
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    want = Counter([(i, texts[i]) for i in range(0, 120, 10)] + [(500, None), (None, "no id"), (None, "other words without id"), (0, "another text under a used id")])
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    clash = df.toDF("doc_id", "text", "gone_id", "text_key", "fp", "stays").withColumn("c0", F.lit("c"))
    again = simhash.one_of_each(clash)
    assert again.columns == clash.columns and again.count() == sum(want.values())
    assert simhash.one_of_each(df.limit(0)).collect() == []


def test_pages_of_one_template_stay_apart(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    frame = [word() for _ in range(270)]
    texts = []
    for _ in range(60):  # different documents on one template, each with a copy of one word changed
        own = [word() for _ in range(34)]
        copy = list(own)
        copy[10] = word()
        texts += [" ".join(frame + own), " ".join(frame + copy)]
    near = jaccard(shingles(texts[0]), shingles(texts[2]))
    assert 0.76 < near < 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_components(texts)
    assert len(set(want)) == 60
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()} == dict(enumerate(want))
    assert simhash.one_of_each(df).count() == 60


@pytest.mark.parametrize("block", [256, 40])
def test_near_groups_lose_no_link_of_a_large_file(spark, block):
    import itertools

    rng = random.Random(1)
    texts, hub = [], [f"w{rng.randrange(10**9)}" for _ in range(304)]
    for _ in range(300):  # edits of one text: like it, less like each other
        words = list(hub)
        for at in rng.sample(range(0, 300, 5), 6):
            words[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    texts = [" ".join(hub), *texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    assert all(jaccard(s, sets[0]) >= 0.8 for s in sets) and all(jaccard(a, b) < 0.8 for a, b in itertools.pairwise(sets[1:]))
    rows = {r["doc_id"]: r for r in simhash.sketches(df, 5).collect()}
    files = Counter(b for r in rows.values() for b in enumerate(r["bands"]))
    assert max(files.values()) > 2 * 40
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        met = any(a == b for a, b in zip(rows[i]["bands"], rows[j]["bands"], strict=True))
        if met and jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert sum(r == 0 for r in root) > 290
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df, block=block).collect()} == dict(enumerate(root))


def test_a_pivot_spares_pairs_but_no_link(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(300)]
    texts = []
    for k in range(150):  # most are close to each other; a chain leads away
        words = list(base)
        words[rng.randrange(300)] = word()
        texts.append(" ".join(words))
    chain = list(base)
    for k in range(6):
        for at in range(k * 35, k * 35 + 33, 8):
            chain[at] = word()
        texts.append(" ".join(chain))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df, block=40).collect()} == dict(enumerate(want))


# ---------------------------------------------------------------- 8


def water_filled(sizes, share=mixing.SHARE, cap=mixing.CAP, weights=mixing.WEIGHTS):
    """Targets by capping whatever is above and sharing again, until nothing is."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    want, capped = share * sum(sizes), set()
    while True:
        left = want - sum(cap * sizes[i] for i in capped)
        heavy = sum(w for i, w in enumerate(weight) if i not in capped)
        level = left / heavy if heavy else 0.0
        over = {i for i in range(len(sizes)) if i not in capped and level * weight[i] > cap * sizes[i]}
        if not over:
            return [float(cap * s) if i in capped else level * weight[i] for i, s in enumerate(sizes)]
        capped |= over


def test_mix_meets_targets(docs, none):
    rows, df = docs
    out = got(mixing.mix(df))
    assert len(out) == len(rows)
    size, aim, took = Counter(), {}, Counter()
    for r in out:
        size[r["source"]] += r["size"]
        aim[r["source"]] = r["target"]
        took[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["copies"] == len(r["positions"])
        assert all(0 <= p <= 1 for p in r["positions"])
    order = sorted(size, key=lambda s: (s is None, s))
    assert [aim[s] for s in order] == pytest.approx(water_filled([size[s] for s in order]))
    assert sum(aim.values()) == pytest.approx(1.5 * sum(size.values()))
    biggest = {s: max(r["size"] for r in out if r["source"] == s) for s in size}
    assert all(abs(took[s] - aim[s]) <= biggest[s] / 2 + 1 and aim[s] <= 2 * size[s] for s in size)
    key = lambda rs: sorted((r["doc_id"], r["size"], r["taken"], str(r["source"])) for r in rs)
    assert key(got(mixing.mix(df))) == key(out)
    assert got(mixing.mix(none)) == []


def test_plans_match_water_filling(spark):
    rng = random.Random(6)
    for sizes in ([10, 1000, 1000], [0, 0], [7], [], [rng.randrange(0, 50) ** 3 for _ in range(200)], [5, 5, 5, 5]):
        names = [None if i == len(sizes) - 1 and len(sizes) > 2 else f"s{i:04d}" for i in range(len(sizes))]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, words long")
        plan = {r["named"]: r for r in mixing.source_plan(df).collect()}
        assert [plan[n]["target"] for n in names] == pytest.approx(water_filled(sizes)) and [plan[n]["tilt"] for n in names] == [mixing.TILTS[i % 3] for i in range(len(names))]
    assert water_filled([10, 1000, 1000]) == [20.0, pytest.approx(1996.67, abs=0.1), pytest.approx(998.33, abs=0.1)]


def test_demand_inverse_and_training_order(spark, docs):
    df = spark.range(11).select((F.col("id") / 10).alias("u"))
    for tilt in (-0.5, 0.0, 0.5):
        for r in df.select("u", mixing.demand_inverse(F.col("u"), F.lit(tilt)).alias("t")).collect():
            assert (1 - tilt) * r["t"] + tilt * r["t"] ** 2 == pytest.approx(r["u"])
    rows, all_docs = docs
    mixed = mixing.mixed_rows(all_docs)
    assert mixed.columns == all_docs.columns
    plan = Counter()
    for r in got(mixing.mix(all_docs)):
        plan[r["doc_id"]] = max(plan[r["doc_id"]], r["copies"])
    n = Counter(r[0] for r in rows)
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: c * n[d] for d, c in plan.items() if c})


# ---------------------------------------------------------------- 9


def brute_capacity(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("knots", [64, 16384])
def test_minimax_cuts_are_exact(knots):
    rng = random.Random(9)
    for _ in range(40):
        sizes = [rng.choice([1, 5, rng.randrange(1, 300)]) for _ in range(rng.randrange(1, 700))]
        ends = np.cumsum(sizes).tolist()
        shards = rng.randrange(1, 9)

        def look(stretches, ends=ends):
            out = []
            for a, b in sharding.merged(stretches):
                width = max(1, -(-(b - a) // max(2, knots // 16)))
                blocks = defaultdict(list)
                for e in ends:
                    if a < e <= b:
                        blocks[(e - 1 - a) // width].append(e)
                out += [(min(v), max(v), len(v)) for v in blocks.values()]
            return out

        capacity, cuts = sharding.minimax_cuts(look, ends[-1], max(sizes), shards)
        assert capacity == brute_capacity(sizes, shards)
        assert cuts[-1] == ends[-1] and max(np.diff([0, *cuts])) == capacity
        assert all(c in ends for c in cuts)


def test_shards_hold_groups_together(spark, docs, none):
    rows, df = docs
    giant = spark.createDataFrame([(10_000 + i, "g" * 5000, "en", "s", 1, "e") for i in range(300)], SCHEMA)
    for table in (df, df.union(giant), df.union(spark.createDataFrame([(None, "no id", "en", "s", 1, "e")], SCHEMA))):
        texts = [(r["doc_id"], r["text"] or "") for r in table.collect()]
        out = got(sharding.assign_shards(table))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts)
        shards, load = defaultdict(list), Counter()
        for r in out:
            shards[r["shard"]].append(r["slot"])
            load[r["shard"]] += r["size"]
            assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        assert all(sorted(s) == list(range(len(s))) for s in shards.values())
        where = defaultdict(set)
        for r in out:
            where[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(len(s) == 1 for s in where.values())
        groups, first = Counter(), {}
        for d, t in texts:
            groups[t] += len(t.encode()) + 1
            d = sharding.NULL_ID if d is None else d
            first[t] = min(first.get(t, d), d)
        # groups above an even share of what is left have a shard of their own, the others are cut where they fit best
        left, rest, giants = 16, sum(groups.values()), []
        for t in sorted(groups, key=lambda t: (-groups[t], hashlib.md5(t.encode()).digest())):
            if left > 1 and groups[t] * left > rest:
                giants.append(t)
                left, rest = left - 1, rest - groups[t]
        small = sorted((t for t in groups if t not in giants), key=lambda t: (first[t], hashlib.md5(t.encode()).digest()))
        home = {t: where[zlib.crc32(t.encode()), len(t.encode()) + 1] for t in groups}
        line = [min(home[t]) for t in small]
        assert line == sorted(line) and max(line) < left and sorted(min(home[t]) for t in giants) == list(range(left, 16))
        assert max(load[s] for s in range(left)) == brute_capacity([groups[t] for t in small], left)
    assert got(sharding.assign_shards(none)) == []


# ---------------------------------------------------------------- 10


def test_warc_round_trip(spark):
    big = "ü" * 600
    html = [None, "", "small", "small", big, big, big, "<p>" + "x" * 2000, "y" * 999, "y" * 999, "\r\n\r\n" * 400]
    rows = [(i * 7, f"http://h/{i}\r\nX: y" if i % 2 else None, h, "extra") for i, h in enumerate(html)] + [(14, "http://again", "small", "extra"), (None, "http://n", big, "extra")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    out = got(warczip.round_trip(pages))
    latest = {}
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and p is not None:
            latest[raw] = max(latest.get(raw, p), p)
    want = Counter()
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        again = raw in latest and latest[raw] != p
        want[p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", latest[raw] if again else None, b"" if again else raw] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["block"])) for r in out) == want
    assert got(warczip.round_trip(pages.limit(0))) == []


def sample_records(n=5):
    rows = []
    for i in range(n):
        raw = b"p" * i
        rows.append((i - 1 if i else None, f"https://www.H.test/{n - i}?Q={i}" if i != 2 else None, raw, hashlib.sha1(raw).hexdigest(), "response", None))
    return [*rows, (77, "https://h.test/again", b"p" * 3, hashlib.sha1(b"ppp").hexdigest(), "revisit", 2)]


def test_record_ids_carry_page_and_digest():
    import uuid

    for page in (None, 0, 1, -1, 2**63 - 1, -(2**63)):
        name = warczip.record_id(page, "ab" * 20)
        assert uuid.UUID(name[10:-1]).version == 8 and uuid.UUID(name[10:-1]).variant == uuid.RFC_4122 and warczip.page_of(name) == page
        assert name != warczip.record_id(page, "cd" * 20)


def test_records_are_valid_warc():
    rows = sample_records()
    raw = warczip.package_bytes(rows)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        data = z.read(warczip.ARCHIVE)
        about = json.loads(z.read("datapackage.json"))
        assert {r["path"]: (r["hash"], r["bytes"]) for r in about["resources"]} == {n: ("sha256:" + hashlib.sha256(z.read(n)).hexdigest(), len(z.read(n))) for n in z.namelist() if n != "datapackage.json"}
        index = z.read(warczip.INDEX).splitlines()
    assert index == sorted(index) and index[0].split(b" ")[:2] == [b"test,h)/1?q=4", b"20240131100000"]
    kinds = []
    plain = gzip.decompress(data)
    while plain:  # by the letter of the standard: version, named fields, block, two line ends
        head, _, rest = plain.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :][:4]
        assert lines[0] == "WARC/1.1" and end == b"\r\n\r\n" and fields["WARC-Date"] == "2024-01-31T10:00:00Z" and fields["WARC-Record-ID"].startswith("<urn:uuid:")
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        kinds.append(fields["WARC-Type"])
        if fields["WARC-Type"] != "warcinfo":
            assert block.startswith(b"HTTP/1.1 200 OK\r\n") and fields["Content-Type"].startswith("application/http")
        if fields["WARC-Type"] == "revisit":
            assert fields["WARC-Profile"] == warczip.PROFILE and fields["WARC-Refers-To"] == warczip.record_id(2, hashlib.sha1(b"ppp").hexdigest()) and block.endswith(b"\r\n\r\n")
        plain = rest[len(block) + 4 :]
    assert kinds == ["warcinfo", *["response"] * 5, "revisit"]


def test_package_is_a_zip_and_zip64_is_read():
    rows = sample_records()
    raw = warczip.package_bytes(rows)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.namelist() == [warczip.ARCHIVE, warczip.INDEX, "pages/pages.jsonl", "datapackage.json"] and z.testzip() is None
        parts = {n: z.read(n) for n in z.namelist()}
    reads = []

    def reader_of(raw):
        return warczip.RangeReader(lambda at, n: reads.append((at, n)) or raw[at : at + n], len(raw))

    want = sorted((str(r[0]), len(r[2]), r[4], str(r[5])) for r in rows)
    pages = lambda reader, **o: sorted((str(x[0]), x[2], x[5], str(x[6])) for x in filter(None, (warczip.page_row(*r) for r in reader.records(**o))))
    reader = reader_of(raw)
    before = len(reads)
    assert pages(reader) == want
    assert len(reads) - before <= 6  # index, headers and all records in one range
    assert pages(reader_of(raw), most=1) == want
    # archives under other names, in another layout, without an index, not compressed
    for name, data, index in (("archive/x.warc.gz", parts[warczip.ARCHIVE], None), ("archive/deep/y.warc", gzip.decompress(parts[warczip.ARCHIVE]), None), ("archive/z.warc.gz", parts[warczip.ARCHIVE], parts[warczip.INDEX].replace(b"data.warc.gz", b"z.warc.gz"))):
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w") as z:
            z.writestr(zipfile.ZipInfo("readme.txt"), b"x")
            z.writestr(zipfile.ZipInfo(name), data)
            if index:
                z.writestr("indexes/i.cdxj", index, zipfile.ZIP_DEFLATED)
        for most in (50, 1 << 20):
            assert pages(reader_of(sink.getvalue()), most=most) == want
    damaged = warczip.parse_record(warczip.record(1, "http://h", b"abc", "00" * 20, "response", None, "2024-01-31T10:00:00Z"))
    with pytest.raises(ValueError):
        warczip.page_row(*damaged)
    # a directory of more entries than the short end record can count
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"x" if i == 65_999 else b"")
        z.comment = b"PK\x05\x06 in a comment"
    many = sink.getvalue()
    reads = []
    reader = warczip.RangeReader(lambda at, n: reads.append(n) or many[at : at + n], len(many))
    assert len(reader.members) == 66_000 and reader.member("m65999") == b"x"
    with pytest.raises(ValueError):
        warczip.RangeReader(lambda at, n: b"no zip"[at : at + n], 6)


def test_wide_fields_come_in_order():
    extra = b"\x01\x00\x10\x00" + (5).to_bytes(8, "little") + (7).to_bytes(8, "little")
    assert warczip.RangeReader._wide(extra, 0xFFFFFFFF, 3, 0xFFFFFFFF) == (5, 3, 7)
