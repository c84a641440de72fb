from pagequarry.operators import links

PAGE = "site string, url string, indexable boolean, links array<struct<url:string,external:boolean,resource:boolean,nofollow:boolean,anchor:string>>"


def told(rows):
    return sorted((r["source"], r["pos"], r["target"], r["anchor"]) for r in rows.collect())


def test_first_links_are_found_in_the_row(spark):
    one = [("/x", False, False, False, "a"), ("", False, False, False, "none"), ("/y", False, False, False, "b"), ("/x", False, False, True, "c")]
    rows = links.link_rows(spark.createDataFrame([("s", "/1", True, one), ("s", "/2", True, one[2:])], PAGE))
    assert told(rows) == [("/1", 0, "/x", "a"), ("/1", 2, "/y", "b"), ("/2", 0, "/y", "b"), ("/2", 1, "/x", "c")]
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_url_are_one_page(spark):
    some = [("s", "/1", True, [("/x", False, False, False, "a")]), ("s", "/1", True, [("/y", False, False, False, "b"), ("/x", False, False, False, "c")])]
    assert told(links.link_rows(spark.createDataFrame(some, PAGE))) == [("/1", 0, "/x", "a"), ("/1", 0, "/y", "b")]
