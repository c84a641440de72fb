from pagequarry.operators import terms

TEXTS = [("a", "stone path stone"), ("b", ""), ("c", None), ("d", "path gravel path stone gravel gravel")]


def told(rows):
    return sorted((r["k"] or "", r["term"], r["n"]) for r in rows.collect())


def test_terms_are_counted_in_the_row(spark):
    rows = terms.term_counts(spark.createDataFrame(TEXTS, "k string, text string"), "k", "text", 2)
    assert ("d", "gravel", 3) in told(rows) and ("d", "path stone", 1) in told(rows) and ("a", "stone path", 1) in told(rows)
    assert {k for k, _, _ in told(rows)} == {"a", "d"}
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_key_are_added(spark):
    docs = spark.createDataFrame([*TEXTS, ("a", "stone wall"), (None, "mud"), (None, "mud mud")], "k string, text string")
    want = [("", "mud", 3), ("a", "path", 1), ("a", "stone", 3), ("a", "wall", 1), ("d", "gravel", 3), ("d", "path", 2), ("d", "stone", 1)]
    assert told(terms.term_counts(docs, "k", "text")) == want
    assert told(terms.term_counts(docs, "k", "text", dominant=1)) == [("", "mud", 3), ("a", "stone", 3), ("d", "gravel", 3)]
