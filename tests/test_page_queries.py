import pytest

from pagequarry import queries
from pagequarry.operators import checks
from pagequarry.sources.dom import parse_html
from pagequarry.sources.html import parse_page


def page(title, body=""):
    return f"<html><head><title>{title}</title></head><body><h1>{title}</h1>{body}</body></html>"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """40 pages of one title, of which two share a URL, and a title that ends in a reference cut short."""
    at = str(tmp_path_factory.mktemp("pages"))
    rows = [(i, f"https://s.test/p{max(i, 1):02}", page("A title of many pages", '<a href="/x">x</a>')) for i in range(40)]
    rows.append((40, "https://s.test/cut", page("One &amp;&amp;&amp &lt;end")))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def test_duplicate_titles_count_all_other_pages(spark, tables):
    rows = [tuple(r) for r in queries.duplicate_titles(spark, tables).collect()]
    assert sorted(others for _, _, others in rows) == [38, 38] + [39] * 38


def test_duplicate_h1_name_the_first_21_pages(spark, tables):
    found = {r["url"]: r["evidence"].split("|") for r in queries.duplicate_h1(spark, tables).collect()}
    first = sorted(f"https://s.test/p{max(i, 1):02}" for i in range(40))[:21]
    assert found["https://s.test/p39"] == ['"a title of many pages"', *(f"also on {u}" for u in first)]
    assert len(found["https://s.test/p05"]) == 21


def test_findings_tell_how_many_pages_share_a_value(spark, tables):
    pages = queries._parsed(spark, tables, "titles").withColumn("site", queries.F.lit(""))
    found = checks.shared_values(pages, queries.F.get("titles", queries.F.lit(0)), "SEO-TITLE-004").where("url like '%p39'").first()
    assert len(found["evidence"]) == 21 and found["evidence"][-1] == "... and 20 more"


def test_followed_links_of_a_url_on_two_pages_are_told_once(spark, tables):
    rows = [tuple(r) for r in queries.followed_links(spark, tables).collect()]
    assert len(rows) == len(set(rows)) == 39


def test_references_without_semicolon_stay_in_titles(spark, tables):
    assert {r["title"] for r in queries.page_titles(spark, tables).where("page_id = 40").collect()} == {"One &&&amp <end"}


def test_closed_references_leave_scripts_and_html_as_they_are():
    text = page("a &amp b", '<!-- & --><script>a && b</script><p>&copy; &#65; &#x42; & &copy')
    told = lambda closed: [n.text for n in parse_html(text, closed).walk() if n.tag is None]
    assert told(True) == ["a &amp b", "a &amp b", "a && b", "© A B & &copy"]
    assert parse_page("https://s.test/", text)["titles"] == ["a & b"]
