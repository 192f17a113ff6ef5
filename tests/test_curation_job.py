"""Fetched pages to programmes, on a few pages with known outcomes."""

from quayside.operators import candidates as C
from quayside.operators import pages as P
from quayside.operators.curate import curate, read_once

SOURCE = "source_id string, ord int, name string, origins array<string>, prefixes array<string>, service_area string, organization_from_title boolean, skip_eligibility boolean, category_by_path map<string,string>"
PAGE = "page_id long, url string, html string, status int, content_type string, source_id string, depth int"
FOOD = "<title>Harbor food bank</title><main><h1>Harbor food bank</h1><p>Apply for free groceries at the hall near the station, every week.</p>{}</main>"


def test_outcomes_and_totals(spark):
    sources = spark.createDataFrame([("a", 1, "Hall", ["https://a.org"], ["/"], "California", False, False, None)], SOURCE)
    rows = [
        (1, "https://a.org/food", FOOD.format('<a href="/apply">Apply for food</a><a href="https://b.org/help">Get help</a><a href="/deep.pdf">Form</a>'), 200, "text/html", "a", 4),
        (2, "https://a.org/food#again", FOOD.format("other"), 200, "text/html", "a", 0),
        (3, "https://a.org/copy", FOOD.format('<a href="/apply">Apply for food</a><a href="https://b.org/help">Get help</a><a href="/deep.pdf">Form</a>'), 200, "text/html", None, 0),
        (4, "https://a.org/museum", "<title>Museum</title><main>Open on Saturday.</main>", 200, "text/html", None, 0), (5, "https://a.org/gone", None, 404, None, "a", 0), (6, "https://a.org/x.bin", "?", 200, "application/octet-stream", "a", 0),
        (7, "https://a.org/wall", "<title>Just a moment</title>", 200, "text/html", "a", 0), (8, "https://a.org/app", "<p>Please enable JavaScript.</p>", 200, "text/html", "a", 0), (9, None, None, None, None, None, None),
        (10, "https://a.org/museum2", "<title>Museum</title><main>Open on Saturday.</main>", 200, "text/html", None, 0), (11, "bad url", FOOD.format("third"), 200, "text/html", None, 0),
    ]
    c = curate(spark.createDataFrame(rows, PAGE), sources)
    got = {r.page_id: (r.outcome, r.reason, r.of) for r in c.outcomes.collect()}
    assert got == {
        1: ("kept", None, None), 2: ("duplicate", "redirect", 1), 3: ("duplicate", "same_content", 1), 4: ("irrelevant", None, None), 5: ("error", "HTTP", None), 6: ("lead", "unsupported_content_type", None), 7: ("error", "ACCESS_CHALLENGE", None),
        8: ("error", "JAVASCRIPT_REQUIRED", None), 9: ("error", "HTTP", None), 10: ("irrelevant", None, None), 11: ("kept", None, None),
    }
    assert {(r.url, r.reason) for r in c.leads.collect()} == {
        ("https://b.org/help", "outside_configured_sources"), ("https://a.org/deep.pdf", "document_needs_extraction"), ("https://a.org/apply", "depth_limit"), ("https://a.org/x.bin", "unsupported_content_type"), ("https://a.org/app", "javascript_required"),
    }
    assert {(r.page_id, r.reason) for r in c.skipped.collect()} == {(4, "No supported assistance topic was found in the main page content."), (10, "No supported assistance topic was found in the main page content.")}
    assert [(r.name, r.organization, r.category, r.n_merged, r.application_url) for r in c.candidates.collect()] == [("Harbor food bank", "Hall", "food", 2, "https://a.org/apply")]
    t = c.totals.first().asDict()
    # leads: three of page 1, two of page 3 (its links lie less deep), two pages
    assert t == {"attempted": 11, "inspected": 7, "errors": 4, "unsupported": 1, "truncated": 0, "kept": 2, "skipped": 2, "duplicates": 2, "leads": 7, "candidates": 1, "uncategorised": 0}


def test_long_pages_are_read_whole(spark):
    pages = spark.createDataFrame([(1, "https://a.org/food", FOOD.format("Meals. " * 10_000), 200, "text/html", "a", 0)], PAGE)
    assert [read_once(pages, whole)[1]["truncated"] for whole in (False, True)] == [1, 0]
    assert read_once(pages, True)[0].first().text.endswith("Meals. " * 9_999 + "Meals.")


def test_a_result_does_not_wait_for_others(spark, monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(C, "make_candidates", never)
    rows = [(1, "https://a.org/food", FOOD.format('<a href="/form.pdf">Apply</a>'), 200, "text/html", "a", 0), (2, "https://a.org/food#b", FOOD.format('<a href="/other.pdf">Apply</a>'), 200, "text/html", "a", 0)]
    sources = spark.createDataFrame([("a", 1, "Hall", ["https://a.org"], ["/"], "California", False, False, None)], SOURCE)
    c = curate(spark.createDataFrame(rows, PAGE), sources)
    assert {(r.page_id, r.outcome, r.of) for r in c.outcomes.collect()} == {(1, "kept", None), (2, "duplicate", 1)}
    monkeypatch.setattr("quayside.operators.curate.same_pages", never)
    assert [r.url for r in curate(spark.createDataFrame(rows, PAGE), sources).leads.collect()] == ["https://a.org/form.pdf"]


def test_nothing_to_curate(spark):
    c = curate(spark.createDataFrame([], PAGE), spark.createDataFrame([], SOURCE))
    assert set(c.totals.first().asDict().values()) == {0} and c.outcomes.count() == c.candidates.count() == c.leads.count() == 0


def test_frontier_takes_the_shortest_way(spark):
    u = lambda k: f"https://a.org/p/{k}"
    edges = [(1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (5, 6), (9, 7), (3, 3)]
    links = spark.createDataFrame([(u(a), u(b), "x", False, "a") for a, b in edges] + [(u(1), "https://a.org/search/1", "x", False, "a"), (u(1), u(8), "x", False, None)], "found_from string, url string, text string, navigation boolean, source string")
    seeds = spark.createDataFrame([(u(1), "a"), (u(1), "a")], "url string, source string")
    got = {r.url: (r.depth, r.score) for r in P.frontier(links, seeds, spark.createDataFrame([("a", 7)], "source string, priority int"), 3).collect()}
    assert {k: d for k, (d, _) in got.items()} == {u(1): 0, u(2): 1, u(4): 1, u(3): 2, u(5): 2, u(6): 3}
    assert got[u(1)][1] == 100_000 + 7 + 6 and got[u(6)][1] == 7 + 6 - 12
    assert [r.rank for r in P.fetch_list(spark.createDataFrame([("a", "u", 1), ("a", "v", 2), ("b", "w", 0)], "source string, url string, score int"), 1, 5).collect()] == [1, 1]
