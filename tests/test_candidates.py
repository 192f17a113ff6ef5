"""Candidates from pages, and their merging against a sequential version."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import candidates as C

PAGE = "ord long, source_id string, url string, canonical string, title string, headings array<string>, description string, text string, excerpt string, links array<struct<url:string,text:string,navigation:boolean,context:string,related:boolean>>, phones array<string>, emails array<string>"
SOURCE = "source_id string, name string, service_area string, organization_from_title boolean, skip_eligibility boolean, category_by_path map<string,string>"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("name", "want"), [("CalFresh  Food!", "calfresh-food"), ("Café para todos", "cafe-para-todos"), ("Naïve", "nai-ve"), ("", "resource"), (None, "resource"), ("x" * 90, "x" * 72)])
def test_slug(spark, name, want):
    assert one(spark, C.slug(F.col("n").cast("string")), n=name) == want


def test_accents(spark):
    assert one(spark, C.fold_accents(F.col("n")), n="ñandú à la") == "nandu a la"


@pytest.mark.parametrize(("name", "about", "url", "want"), [
    ("FAQ", "", "https://a.org/x", True), ("What is CalFresh?", "x" * 90, "https://a.org/x", True), ("Rent relief fund", "x" * 90, "https://a.org/x", False), ("Rent relief", "x" * 90, "https://a.org/my_county/x", True),
    ("Our partners at work", "short", "https://a.org/x", True), ("Our partners at work", "x" * 90, "https://a.org/x", False), (None, None, None, False),
])
def test_navigation(spark, name, about, url, want):
    assert one(spark, C.is_navigation(*(F.col(k).cast("string") for k in "nau")), n=name, a=about, u=url) is want


@pytest.mark.parametrize(("html", "text", "relevant", "want"), [
    ("<title>Just a moment...</title>", "", True, "challenge"), ("<script src=cf-chl-x>" + " " * 20_000, "x" * 300, True, "candidate"), ("<script src=cf-chl-x>", "x" * 300, True, "challenge"),
    ("Please enable JavaScript", "Please", True, "script_shell"), ("Please enable JavaScript", "x" * 300, True, "candidate"), ("<p>", "x", False, "irrelevant"), (None, None, None, "irrelevant"),
])
def test_outcome(spark, html, text, relevant, want):
    df = spark.createDataFrame([(html, text, relevant)], "h string, t string, r boolean")
    assert df.select(C.page_outcome(F.col("h"), F.col("t"), F.col("r"))).first()[0] == want


def test_candidates(spark):
    long = "Groceries every week for families who need them, handed out at the hall near the station, with no questions asked at all."
    links = [("https://a.org/m", "Apply for food", True), ("https://a.org/c", "Contact us", False), ("https://a.org/z", "Apply for loans", False), ("https://a.org/f", "Food boxes: apply", False), ("https://a.org/n", "News", False)]
    links = [(*x, "around it", False) for x in links] + [("https://a.org/r", "Elsewhere", False, "", True), ("https://a.org/s", "Elsewhere", True, "", True)]
    pages = [
        (1, "s", "https://a.org/food/", None, "Food boxes | Hall", ["Menu", "Food boxes"], "Short", f"Food boxes Home {long} Food boxes {long}", "", links, ["4085550100"], []),
        (2, "s", "https://a.org/x", "https://a.org/y", "Contact us", [], None, None, None, [], [], []), (3, None, "https://b.org/p", None, None, None, None, None, None, None, None, None),
        (4, "t", "https://a.org/caleitc", None, "CalEITC page", [], "d", "x", "", [], [], []),
    ]
    sources = [("s", "Hall", "California", True, False, {"/food": "shelter"}), ("t", "T", "US", False, True, None)]
    got = {r.ord: r for r in C.make_candidates(spark.createDataFrame(pages, PAGE), spark.createDataFrame(sources, SOURCE)).collect()}
    assert set(got) == {1, 3, 4}
    r = got[1]
    assert (r.name, r.organization, r.category, r.application_url, r.phone) == ("Food boxes", "Food boxes", "shelter", "https://a.org/f", "4085550100")
    assert r.description == f"Food boxes {long}" and [(x.url[-1], x.context, x.related) for x in r.linked] == [("z", "around it", False), ("f", "around it", False), ("r", "", True)] and r.id.startswith("food-boxes-")
    assert (got[3].name, got[3].organization, got[3].application_url) == ("/p", None, "https://b.org/p")
    assert (got[4].name, got[4].organization, got[4].eligibility) == (C.TAX_CREDIT_NAME, C.TAX_CREDIT_OFFICE, None)


def sequential(keys, flags):
    """Candidates one after the other: (ord -> group, group -> ord of its record)."""
    at, group, record, state = {}, {}, {}, {}
    for o in sorted(keys):
        found = next((at[k, x] for k, x in enumerate(keys[o]) if x is not None and (k, x) in at), None)
        e, p, g = flags[o]
        if found is None:
            found = o
            record[o], state[o] = o, (e, g)
        else:
            had, gov = state[found]
            if (p and (e or not had)) or (g and not gov and (e or not had)) or (e and not had):
                record[found], state[found] = o, (e, g)
        group[o] = found
        at.update({(k, x): found for k, x in enumerate(keys[o]) if x is not None})
    return group, record


@pytest.mark.parametrize("seed", range(3))
def test_merge_is_sequential(spark, monkeypatch, seed):
    monkeypatch.setattr(C, "SPAN", 7)
    rnd = random.Random(seed)
    rows, keys, flags = [], {}, {}
    for o in range(120):
        name, text, office = rnd.randrange(25), rnd.choice([None, *range(12)]), rnd.randrange(3)
        p = rnd.random() < 0.15
        g = p or rnd.random() < 0.3
        e = rnd.random() < 0.3
        url = f"https://www.ftb.ca.gov/caleitc/{o}" if p else f"https://x{'.ca.gov' if g else '.org'}/{o}"
        label = f"Harbor aid {name}" if name % 2 else f"Food help for {name}"
        about = "short" if text is None else f"Long description number {text} " + "word " * 20
        rows.append((o, label, f"Org {office}", "food", ["US"], about, url, e, [("u%d" % rnd.randrange(4), f"t{o}")]))
        keys[o] = (("n", office, name), None if text is None else ("d", office, text), ("s", name) if name % 2 else None)
        flags[o] = (e, p, g)
    df = spark.createDataFrame(rows, "ord long, name string, organization string, category string, service_area array<string>, description string, source_url string, eligibility boolean, linked array<struct<url:string,text:string>>")
    merged, links = C.merge_candidates(df)
    group, record = sequential(keys, flags)
    assert {(r.group, r.ord) for r in merged.collect()} == set(record.items())
    want = {}
    for o in range(120):
        for u, t in rows[o][-1]:
            want[group[o], u] = t
    assert {(r.group, r.url): r.text for r in links.collect()} == want


def test_owners_and_definitions(spark):
    sources = spark.createDataFrame([("a", 1, ["https://x.org"], ["/"]), ("b", 2, ["https://x.org"], ["/p"])], "source_id string, ord int, origins array<string>, prefixes array<string>")
    links = spark.createDataFrame([("https://x.org/p/1", "b"), ("https://x.org/q", "b"), ("https://y.org/", "a"), ("https://x.org/p/1", None)], "url string, found_by string")
    assert sorted((r.url, r.found_by or "", r.owner) for r in C.owners(links, sources).collect()) == [("https://x.org/p/1", "", "a"), ("https://x.org/p/1", "b", "b"), ("https://x.org/q", "b", "a"), ("https://y.org/", "a", None)]
    r = C.with_definitions(spark.createDataFrame([("a", "Recorded", None), ("c", "C", None)], "source_id string, name string, area string"), spark.createDataFrame([("a", "Defined", "US", True)], "source_id string, name string, area string, flag boolean"))
    assert sorted(map(tuple, r.select("source_id", "name", "area", "flag").collect())) == [("a", "Recorded", "US", True), ("c", "C", None, None)]


def test_empty(spark):
    empty = spark.createDataFrame([], PAGE)
    made = C.make_candidates(empty, spark.createDataFrame([], SOURCE))
    merged, links = C.merge_candidates(made)
    assert merged.count() == 0 and links.count() == 0
