import random

import pytest

from pagequarry.operators import duplicates


@pytest.fixture(scope="module")
def hashes():
    """Crowds around few centres, and copies."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    found = {}
    for key in range(200):
        h = rng.choice(centres)
        for _ in range(rng.choice([0, 0, 1, 3, 5, 7])):
            h ^= 1 << rng.randrange(64)
        found[key] = h - (1 << 64) if h >> 63 else h
    return found


def near(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= 5


def test_near_pages_meet_without_broadcast(spark, hashes):
    """Files are 56 times the hashes that they are made of, while their estimated size is that of the hashes."""
    spark.createDataFrame(list(hashes.items()), "id long, simhash long").createOrReplaceTempView("hashes")
    plan = duplicates.near_pairs(spark.table("hashes").limit(100), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_groups_that_settle_in_turn_follow_leaders_of_all_pages(spark, hashes):
    leaders, want = [], set()
    for key, h in hashes.items():
        first = next((k for k in leaders if near(hashes[k], h)), None)
        leaders, want = (leaders + [key], want) if first is None else (leaders, want | {(first, key)})
    df = spark.createDataFrame(list(hashes.items()), "id long, simhash long")
    assert {tuple(r) for r in duplicates.near_groups(df, "id", few=10).collect()} == want


def test_blocks_of_a_large_file_lose_no_link(spark, hashes):
    df = spark.createDataFrame(list(hashes.items()), "id long, simhash long")
    met = duplicates._met(df.selectExpr("id a", "simhash ha"), df.selectExpr("id b", "simhash hb"), block=3)
    want = sorted((a, b) for a in hashes for b in hashes if near(hashes[a], hashes[b]))
    assert sorted((r["a"], r["b"]) for r in met.collect()) == want


def test_links_count_all_near_pages(spark, hashes):
    df = spark.createDataFrame(list(hashes.items()), "id long, simhash long")
    want = {k: (min(x for x in hashes if hashes[x] == h), sum(near(h, g) for g in hashes.values()) - 1) for k, h in hashes.items()}
    assert {r["id"]: (r["class_id"], r["links"]) for r in duplicates.near_links(df, "id").collect()} == want
