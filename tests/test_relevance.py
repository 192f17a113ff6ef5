"""Pages that offer help, and pages that only mention it."""

import pytest
from pyspark.sql import functions as F

from quayside.functions.relevance import category, relevance, whole_words

SCHEMA = "url string, title string, description string, headings array<string>, text string, links array<struct<url:string,text:string,navigation:boolean,context:string,related:boolean>>"


def judged(spark, **page):
    row = {"url": "https://a.org/p", "title": "", "description": "", "headings": [], "text": "", "links": []} | page
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.replace("<url:string,text:string,navigation:boolean>", "").split(", "))], SCHEMA)
    return df.select(relevance(*map(F.col, ("url", "title", "description", "headings", "text", "links"))).alias("r")).first().r


@pytest.mark.parametrize(("page", "relevant", "topics"), [
    ({"title": "CalFresh food help", "text": "Apply today."}, True, ["food"]), ({"title": "Our history", "text": "Founded in 1950."}, False, []), ({"title": "Food prices rose"}, False, ["food"]),
    ({"title": "Rent relief", "description": "Get help", "text": "Rental assistance."}, True, ["rental_assistance"]), ({"title": "Request for proposals: food services"}, False, ["food"]),
    ({"title": "Job openings at the county", "text": "Apply for jobs."}, False, ["employment"]), ({"title": "Current vacancies for job seekers", "text": "Job training, apply."}, True, ["employment"]),
    ({"url": "https://a.org/news/1", "title": "Food bank", "text": "Apply."}, False, ["food"]), ({"url": "https://a.org/news/1", "title": "Food bank", "text": "Apply.", "links": [("u", "Apply here", False, "", False)]}, True, ["food"]),
    ({"title": "Hearing aids services"}, False, []), ({"description": "food help everywhere", "title": "Home"}, False, ["food"]), ({"title": None, "text": None}, False, []),
])
def test_relevance(spark, page, relevant, topics):
    r = judged(spark, **page)
    assert (r.relevant, r.topics) == (relevant, topics)


@pytest.mark.parametrize(("url", "name", "text", "want"), [
    ("https://a.org/x", "Food bank and legal aid", "", "food"), ("https://a.org/housing-programs/x", "Keys", "Housing for all", "rental_assistance"), ("https://a.org/x", "Keys", "legal aid, then a food bank", "legal"), ("https://a.org/x", "Keys", None, None),
])
def test_category(spark, url, name, text, want):
    assert spark.createDataFrame([(url, name, text)], "u string, n string, d string").select(category(F.col("u"), F.col("n"), F.col("d"))).first()[0] == want


def test_letters_that_no_word_begins_with_are_passed_over():
    assert whole_words("rent(?:al|s)?|(?<!no )housing") == r"(?i)(?=[hr])\b(?:rent(?:al|s)?|(?<!no )housing)\b"
    assert whole_words("(?:a|b)c|d") == r"(?i)\b(?:(?:a|b)c|d)\b"


def test_terms_of_all_fields_in_their_order(spark):
    r = judged(spark, title="Hearing", headings=["aids services"], description="SNAP for tenants", text="Meals; apply or get help. Food for tenants")
    assert r.matched_terms == ["tenants", "snap", "aids services", "apply", "services", "get help"] and r.topics == ["rental_assistance", "food", "hiv_aids"]
