"""The rule dimension: every finding refers to one of these.

Ids, severities and categories are fixed values; titles and advice are our own words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SEVERITIES = {"info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}
PENALTIES = {"info": 0, "low": 1, "medium": 3, "high": 8, "critical": 20}
CATEGORIES = {
    "crawlability": "Crawlability",
    "metadata": "Metadata",
    "content": "Content",
    "structured-data": "Structured data",
    "internal-linking": "Internal linking",
    "web-hygiene": "Web hygiene",
}
#: Report groups in display order.
GROUPS = list(CATEGORIES)

# id | severity | category | title | advice
_TABLE = """
SEO-ANCHOR-001|info|metadata|Link without text|Give every link readable text or an image with alt text.
SEO-ANCHOR-002|info|metadata|One link text, several targets on a page|Use a text of its own for each target.
SEO-BREADCRUMB-001|medium|structured-data|Breadcrumb list is malformed|List ListItem objects in itemListElement.
SEO-BREADCRUMB-002|low|structured-data|Breadcrumb entry is invalid|Give each entry a name, a valid URL and its position from 1.
SEO-BREADCRUMB-003|low|structured-data|Breadcrumb position or target repeats|Use each position and target once.
SEO-CANONICAL-001|low|metadata|No canonical URL|Declare the page's preferred URL.
SEO-CANONICAL-002|high|metadata|Conflicting canonical URLs|Declare exactly one canonical URL.
SEO-CANONICAL-003|low|metadata|Canonical URL is relative|Write the canonical URL in absolute form.
SEO-CANONICAL-004|high|metadata|Canonical URL is invalid|Correct or remove the declaration.
SEO-CANONICAL-005|medium|metadata|Canonical outside the head|Move the declaration into the head.
SEO-CANONICAL-006|info|metadata|Canonical points to another site|Confirm that the other site should be indexed instead.
SEO-CANONICAL-007|high|metadata|Canonical target fails|Point to a page that answers successfully.
SEO-CANONICAL-008|medium|metadata|Canonical target redirects|Point to the final URL.
SEO-CANONICAL-009|high|metadata|Canonical loop|Let the chain end at one page.
SEO-CANONICAL-010|medium|metadata|Canonical chain|Point directly to the last page.
SEO-CONTENT-001|info|content|Little main text among much markup text|Raise the share of main text.
SEO-CONTENT-002|low|content|Very short main text|Add useful text or merge the page.
SEO-CONTENT-003|medium|content|No main text|Make sure the page has text without scripts.
SEO-DESC-001|medium|metadata|No meta description|Add a description.
SEO-DESC-002|medium|metadata|Empty meta description|Fill in the description.
SEO-DESC-003|low|metadata|Several meta descriptions|Keep one description.
SEO-DESC-004|low|metadata|Meta description shared by pages|Write a description for each page.
SEO-DESC-005|info|metadata|Unusual length of meta description|Aim for 50 to 160 characters.
SEO-DUPLICATE-001|medium|content|Pages with identical text|Merge the pages or name one canonical.
SEO-DUPLICATE-002|low|content|Pages with nearly identical text|Tell the pages apart or merge them.
SEO-HEADING-001|medium|metadata|No main heading|Add an h1.
SEO-HEADING-002|low|metadata|Several main headings|Keep one h1.
SEO-HEADING-003|low|metadata|Empty heading|Fill in or remove the heading.
SEO-HEADING-004|low|metadata|Heading levels skip|Nest headings level by level.
SEO-HEADING-005|low|metadata|Main heading shared by pages|Give each page its own h1.
SEO-HREFLANG-001|low|metadata|Alternate language target is relative|Use absolute URLs.
SEO-HREFLANG-002|medium|metadata|One language, different targets|Name one target for each language.
SEO-HREFLANG-003|low|metadata|Invalid language code|Use a language and, if needed, a country code.
SEO-HREFLANG-004|low|metadata|Page missing among its alternates|List the page itself.
SEO-HREFLANG-005|info|metadata|No default alternate|Add x-default.
SEO-HREFLANG-006|medium|metadata|Alternate page cannot be indexed|Point to a working, indexable page.
SEO-HREFLANG-007|medium|metadata|Alternate page does not link back|Declare alternates both ways.
SEO-HTTP-001|high|crawlability|URL fails|Repair or unlink the URL.
SEO-HTTP-002|info|crawlability|URL redirects|Link to the final URL.
SEO-HTTP-003|medium|crawlability|HTML cannot be read|Serve a valid HTML document.
SEO-IMAGE-001|low|content|Image without alt|Describe the image or give it an empty alt.
SEO-IMAGE-002|info|content|Image without size|State width and height.
SEO-IMAGE-003|low|content|Unknown image loading mode|Use lazy or eager.
SEO-INDEX-001|low|crawlability|Page excluded from the index|Confirm that this is meant.
SEO-INDEX-002|low|crawlability|Page tells robots to follow no link|Confirm that this is meant.
SEO-INDEX-003|medium|crawlability|Contradictory robots directives|Keep one of them.
SEO-INDEX-004|low|crawlability|Unknown robots directive|Correct or remove it.
SEO-INDEX-005|info|crawlability|Search previews restricted|Confirm that this is meant.
SEO-INDEX-006|critical|crawlability|Start page excluded from the index|Remove noindex.
SEO-INDEX-007|low|crawlability|Excluded page names another canonical|Choose noindex or a canonical.
SEO-LANG-001|low|metadata|Document language missing|Set the lang attribute of html.
SEO-LANG-002|low|metadata|Document language invalid|Use a valid language tag.
SEO-LANG-003|low|metadata|Document language differs from its alternate|Let both name one language.
SEO-LINK-001|medium|internal-linking|Page without inbound links|Link to it from a related page.
SEO-LINK-002|info|internal-linking|Page links to itself|Remove the link.
SEO-LINK-003|info|internal-linking|One link text, several targets on the site|Use a text of its own for each target.
SEO-LINK-004|high|internal-linking|Broken internal target|Repair or remove the link.
SEO-LINK-005|info|internal-linking|Long way from the start page|Link closer to the start.
SEO-LINK-006|info|internal-linking|Many links on a page|Keep the links that help.
SEO-LINK-007|info|internal-linking|Internal link marked nofollow|Let robots follow internal links.
SEO-LINK-008|low|internal-linking|Broken external link|Repair or remove the link.
SEO-ROBOTS-001|info|crawlability|No robots.txt|Add one if crawlers need rules.
SEO-ROBOTS-002|high|crawlability|robots.txt unavailable|Serve it without errors.
SEO-ROBOTS-003|critical|crawlability|robots.txt blocks the start page|Allow the start page.
SEO-ROBOTS-004|high|crawlability|robots.txt blocks this crawler|Allow it to audit the site.
SEO-ROBOTS-005|low|crawlability|Syntax problems in robots.txt|Correct the lines.
SEO-ROBOTS-006|info|crawlability|robots.txt names no sitemap|Add a Sitemap line.
SEO-ROBOTS-007|low|crawlability|Invalid sitemap address in robots.txt|Use an absolute URL.
SEO-ROBOTS-008|medium|crawlability|robots.txt too large|Shorten it.
SEO-ROBOTS-009|info|crawlability|robots.txt redirects|Serve it at its own address.
SEO-SCHEMA-001|medium|structured-data|Invalid JSON-LD|Correct the JSON.
SEO-SCHEMA-002|low|structured-data|JSON-LD node without a type|Add @type.
SEO-SCHEMA-003|low|structured-data|JSON-LD without the schema.org context|Set @context.
SEO-SCHEMA-004|medium|structured-data|Required property missing|Add the property.
SEO-SCHEMA-005|info|structured-data|Recommended property missing|Consider adding it.
SEO-SCHEMA-006|low|structured-data|Invalid URL in structured data|Correct the URL.
SEO-SCHEMA-007|info|structured-data|Structured data only partly read|Use fewer or smaller blocks.
SEO-SCHEMA-008|info|structured-data|No structured data|Consider adding some.
SEO-SITEMAP-001|low|crawlability|No sitemap|Publish a sitemap.
SEO-SITEMAP-002|medium|crawlability|Sitemap unavailable|Serve it without errors.
SEO-SITEMAP-003|medium|crawlability|Sitemap cannot be read|Publish valid sitemap XML.
SEO-SITEMAP-004|medium|crawlability|Sitemap too large|Split it.
SEO-SITEMAP-005|low|crawlability|Problems in a sitemap|Correct the entries.
SEO-SITEMAP-006|low|crawlability|Sitemap lists other sites|List pages of this site.
SEO-SITEMAP-007|low|crawlability|Sitemap lists invalid URLs|Correct the URLs.
SEO-SITEMAP-008|info|crawlability|Sitemap limits reached|Raise the limits to see the rest.
SEO-SITEMAP-010|medium|crawlability|Sitemap lists a URL that cannot be indexed|List working, canonical, indexable URLs.
SEO-SOCIAL-001|info|metadata|No social metadata|Consider adding some.
SEO-SOCIAL-002|info|metadata|Social titles or descriptions differ|Let them agree.
SEO-SOCIAL-003|low|metadata|Social values repeat|Keep one of each.
SEO-SOCIAL-004|low|metadata|Social image address invalid|Use an absolute http URL.
SEO-SOCIAL-005|low|metadata|Social metadata incomplete|Add the missing properties.
SEO-TERMS-001|info|content|Term on most pages|Check that it helps each page.
SEO-TERMS-002|info|content|Terms of one page only|Check that they describe the page.
SEO-TERMS-003|low|content|Pages share their main terms|Tell the pages apart.
SEO-TITLE-001|high|metadata|No title|Add a title.
SEO-TITLE-002|high|metadata|Empty title|Fill in the title.
SEO-TITLE-003|medium|metadata|Several titles|Keep one title.
SEO-TITLE-004|medium|metadata|Title shared by pages|Give each page its own title.
SEO-TITLE-005|low|metadata|Short title|Use at least 15 characters.
SEO-TITLE-006|low|metadata|Long title|Use at most 65 characters.
WEB-HYGIENE-001|medium|web-hygiene|Page not served over HTTPS|Serve it over HTTPS.
WEB-HYGIENE-002|low|web-hygiene|Content sniffing not switched off|Send X-Content-Type-Options: nosniff.
WEB-HYGIENE-003|low|web-hygiene|No referrer policy|Send Referrer-Policy.
WEB-HYGIENE-004|low|web-hygiene|HTTP does not lead to HTTPS|Redirect HTTP to HTTPS.
WEB-HYGIENE-005|medium|web-hygiene|Insecure resources on a secure page|Load them over HTTPS.
WEB-HYGIENE-006|low|web-hygiene|No strict transport security|Send Strict-Transport-Security with max-age.
WEB-HYGIENE-007|low|web-hygiene|No content security policy|Send Content-Security-Policy.
WEB-HYGIENE-008|low|web-hygiene|Page may be framed|Send frame-ancestors or X-Frame-Options.
"""

RULES = [tuple(line.split("|")) for line in _TABLE.strip().splitlines()]
SCHEMA = "id string, severity int, severity_name string, category string, title string, advice string"
_ID = re.compile(r"(SEO|WEB)-[A-Z]+-\d{3}")


def check_rules(rules=RULES) -> None:
    """Ids are well-formed and unique, and every field is filled."""
    ids = [r[0] for r in rules]
    if len(ids) != len(set(ids)):
        raise ValueError("a rule id repeats")
    for r in rules:
        if len(r) != 5 or not all(r) or not _ID.fullmatch(r[0]) or r[1] not in SEVERITIES or r[2] not in CATEGORIES:
            raise ValueError(f"bad rule {r}")


def rule_rows() -> list[tuple]:
    check_rules()
    return [(i, SEVERITIES[s], s, c, t, a) for i, s, c, t, a in RULES]


def rules_table(spark: SparkSession) -> DataFrame:
    """109 rows, by id."""
    return spark.createDataFrame(sorted(rule_rows()), SCHEMA)
