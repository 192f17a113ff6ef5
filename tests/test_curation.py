"""Urls, pages and promotion on small cases with known results."""

import pytest
from pyspark.sql import functions as F

from quayside.functions import urls as U
from quayside.operators import packet, pages
from quayside.operators.promote import SERVICE_AREA


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "u string").select(column(F.col("u"))).first()[0]


@pytest.mark.parametrize(("url", "want"), [
    ("HTTP://Example.ORG:80#top", "http://example.org/"), ("https://a.org/x?utm_source=f&b=2&a=1&a=0", "https://a.org/x?a=1&a=0&b=2"), ("https://a.org/a b", "https://a.org/a%20b"),
    ("https://u:p@a.org/", None), ("ftp://a.org/", None), ("nonsense", None), (None, None),
])
def test_normal_form(spark, url, want):
    assert one(spark, url, U.normalize_url) == want


@pytest.mark.parametrize(("link", "want"), [
    ("apply.html", "https://a.org/x/apply.html"), ("../y", "https://a.org/y"), ("./", "https://a.org/x/"), ("?p=2", "https://a.org/x/z?p=2"), ("//b.org/q", "https://b.org/q"), ("/r/../s", "https://a.org/s"), ("http://c.org/k", "http://c.org/k"), ("../../../t", "https://a.org/t"), ("mailto:x@a.org", "mailto:x@a.org"),
])
def test_links_are_resolved_against_their_page(spark, link, want):
    assert one(spark, link, lambda c: U.resolve(F.lit("https://a.org/x/z?k=1#f"), c)) == want


def test_scope_kinds_and_traps(spark):
    scope = lambda u: one(spark, u, lambda c: U.in_scope(c, F.array(F.lit("https://a.org")), F.array(F.lit("/Help/"), F.lit("/b"))))
    assert [scope(u) for u in ("https://a.org/help", "https://a.org/help/x", "https://a.org/helper", "https://b.org/help", "https://a.org/B/1", None)] == [True, True, False, False, True, False]
    assert [one(spark, u, U.document_kind) for u in ("https://a.org/x.PDF", "https://a.org/x.css", "https://a.org/x")] == ["document", "asset", "page"]
    assert [one(spark, u, U.crawl_trap) for u in ("https://a.org/search/x", "https://a.org/x?sid=1", "https://a.org/x?page=1")] == [True, True, False]


@pytest.mark.parametrize(("area", "ok"), [("US", True), ("California", True), ("Santa Clara County, CA", True), ("Santa Clara and San Mateo counties, CA", True), ("San Jose, CA", True), ("somewhere", False), ("San Jose", False)])
def test_service_area_forms(spark, area, ok):
    assert one(spark, area, lambda c: c.rlike(SERVICE_AREA)) is ok


HTML = """<html><head><title> A &amp; B </title><meta name="description" content="d"><script>x</script></head><body><nav><a href="/n">menu</a></nav>
<main><h1>Help  now</h1><p>Call (415) 555-1234 or 415.555.1234, mail A@b.org</p><a href="tel:+1-415-555-1234">t</a><a href="/apply">Apply</a></main><footer>foot</footer></body></html>"""


def test_page_record(spark):
    r = pages.extract_pages(spark.createDataFrame([(1, "https://a.org/p", HTML), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert (r[0].title, r[0].description, r[0].headings, r[0].phones, r[0].emails) == ("A & B", "d", ["Help now"], ["+1-415-555-1234"], ["A@b.org"])
    assert "menu" not in r[0].text and "foot" not in r[0].text and "x" not in r[0].text.split()
    assert [(x.url, x.navigation) for x in r[0].links] == [("https://a.org/apply", False), ("https://a.org/n", True)]
    assert r[1].text == "" and r[1].links == []


@pytest.mark.parametrize(("raw", "key"), [("Photo ID", "id"), ("Signed lease", "lease"), ("3-day notice", "notice"), ("PG&E bill", "utilityBill"), ("Pay stubs", "income"), ("Proof of address", "address"), ("Something", "raw:something")])
def test_document_kinds(spark, raw, key):
    assert one(spark, raw, packet.document_key) == key
