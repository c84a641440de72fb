import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry.functions import hashing, text, urls
from pagequarry.rules import RULES, check_rules, rules_table

CASES = {
    "HTTP://EXAMPLE.com/": "http://example.com/",
    "https://Kiosk.example:443/list": "https://kiosk.example/list",
    "https://example.com:0008080/a": "https://example.com:8080/a",
    "https://example.com/%7ejo/%2e%2e/x": "https://example.com/x",
    "https://example.com/50%": "https://example.com/50%25",
    "https://example.com/zażółć?b=ł&a=1": "https://example.com/za%C5%BC%C3%B3%C5%82%C4%87?b=%C5%82&a=1",
    "https://straße.example": "https://xn--strae-oqa.example/",
    "https://under_score.example/": "https://under_score.example/",
    "https://example.com./a#f": "https://example.com/a",
    "https://kiosk.example/x/./y/../../z/": "https://kiosk.example/z/",
}


@pytest.mark.parametrize(("raw", "want"), CASES.items())
def test_normal_form(raw, want):
    assert urls.normalize(raw) == want
    assert urls.normalize(want) == want


@pytest.mark.parametrize(("raw", "why"), [("ftp://h/", "not-http"), ("//h/x", "invalid"), ("https://u:p@h/", "credentials"), ("https://h:0/", "invalid"), ("https://h:70000/", "invalid"), ("https:///x", "invalid"), ("https://h/" + "a" * 3000, "too-long"), ("https://a%20b/", "invalid"), ("mailto:x@y", "not-http")])
def test_bad_urls(raw, why):
    with pytest.raises(urls.BadUrl, match=why):
        urls.normalize(raw)


@pytest.mark.parametrize(("ref", "want"), [("x", "https://h.test/a/x"), ("/x", "https://h.test/x"), ("../x", "https://h.test/x"), ("?q=1", "https://h.test/a/b?q=1"), ("#f", "https://h.test/a/b"), ("//o.test/y", "https://o.test/y"), (" \tx\n", "https://h.test/a/x"), ("", "https://h.test/a/b"), ("./", "https://h.test/a/")])
def test_resolution(ref, want):
    assert urls.normalize(ref, "https://h.test/a/b") == want


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_normal_form_is_a_fixed_point(tail):
    once = urls.try_normalize("https://h.test/" + tail)
    assert not once or urls.normalize(once) == once


def test_site_keys_and_resources(spark):
    rows = [("https://www.h.test/", "h.test", False), ("http://h.test:8080/a.PDF", "h.test:8080", True), ("https://www.www.h.test/x.d/y", "www.h.test", False), ("https://h.test:443/a.tar.gz?x=.html", "h.test", True)]
    for r in spark.createDataFrame(rows, "url string, site string, res boolean").select("*", urls.site_key(F.col("url")).alias("k"), urls.is_resource_url(F.col("url")).alias("r")).collect():
        assert (r["k"], r["r"]) == (r["site"], r["res"]) == (urls.site_key_of(r["url"]), urls.is_resource(r["url"]))


def test_patterns(spark):
    rows = [("https://h.test/a/12/b3?z=1&a9=2", "/a/{n}/b{n}?a{n}&z"), ("https://h.test/", "/"), ("https://h.test/x?q", "/x?q")]
    for r in spark.createDataFrame(rows, "url string, want string").select("want", urls.url_pattern(F.col("url")).alias("p")).collect():
        assert r["p"] == r["want"]


def test_tokens_and_grams(spark):
    rows = [("The Quick brown-fox, 42 zażółć!", ["quick", "brown", "fox", "42", "zażółć"]), ("", []), (None, []), ("a_b " + "x" * 41, ["b"]), ("Być albo nie być", [])]
    df = spark.createDataFrame(rows, "t string, want array<string>").select("want", text.tokens(F.col("t")).alias("w"))
    for r in df.select("*", text.grams(F.col("w")).alias("g")).collect():
        assert r["w"] == r["want"]
        n = len(r["w"])
        assert r["g"] == [" ".join(r["w"][i : i + k]) for i in range(n) for k in (1, 2, 3) if i + k <= n]


def test_text_helpers(spark):
    r = spark.range(1).select(text.collapse(F.lit(" a \n b\t")).alias("c"), text.shortened(F.lit("abcdef"), 4).alias("s"), text.printable(F.lit("a\x07b‍c\nd")).alias("p"), text.nfc(F.lit("é")).alias("n"), text.tenths(F.lit(0.12345)).alias("t")).first()
    assert (r["c"], r["s"], r["p"], r["n"], r["t"]) == ("a b", "abc…", "abc\nd", "é", 12.3)


def fnv(word):
    h = 14695981039346656037
    for b in word.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def test_fnv_and_simhash(spark):
    words = ["foo", "", "zażółć", "a", "x" * 30]
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.fnv1a(F.col("w")).alias("h")).collect():
        assert r["h"] % 2**64 == fnv(r["w"])
    docs = {1: ["a", "b", "b"], 2: ["a"], 3: ["c", "d"], 4: [], 5: None, 6: [f"w{i % 700}" for i in range(70_000)], 7: ["zażółć", "", "x" * 300]}
    out = {r["k"]: r["simhash"] for r in hashing.token_simhash(spark.createDataFrame(list(docs.items()), "k int, w array<string>"), "k", "w").collect()}
    assert set(out) == {1, 2, 3, 6, 7}
    for k, simhash in out.items():
        votes = [sum(1 if h >> b & 1 else -1 for h in map(fnv, docs[k])) for b in range(64)]
        assert simhash % 2**64 == sum(1 << b for b in range(64) if votes[b] < 0)


def test_rules(spark):
    assert rules_table(spark).count() == 109
    with pytest.raises(ValueError):
        check_rules([*RULES, RULES[0]])
    with pytest.raises(ValueError):
        check_rules([("bad", "low", "content", "t", "a")])




def test_texts_are_cut_by_bytes(spark):
    cases = {"short": "short", "x" * 10: "x" * 10, "x" * 11: "x" * 10 + "…", "żółćżółć": "żółćż…", "a€€€€": "a€€€…", "ab€€€€": "ab€€…", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.cut_bytes(F.col("t"), 10).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases
