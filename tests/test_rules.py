"""Rules that pages state; the sentences and what they say are fixed values."""

import pytest
from pyspark.sql import functions as F

from quayside.functions import rules


@pytest.fixture(scope="module")
def stated(spark):
    def run(*texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", rules.eligibility(F.col("t")).alias("e")).collect()
        return [{k: v for k, v in r.e.asDict().items() if v is not None} if r.e else {} for r in sorted(rows, key=lambda r: r.k)]

    return run


def test_income(stated):
    got = stated(
        "Households at or below 80% of Area Median Income may apply.", "Income must be under 200% of the federal poverty level.", "200% of the poverty guidelines", "Income limit: 60% of state median income.", "A household of 1 should be earning less than $82,450 a year.",
        "Have earned income of at least $1 and not more than $32,900.", "under $20,000 annually", "Funding for low-income Santa Clara County residents.", "Income limits apply", "up to $0 a year, low-income", "80 percent AMI and low income", "gross income of $40,000 per year",
    )
    assert got[:2] == [{"max_ami_percent": 80}, {"max_fpl_percent": 200}] and got[2] == {"max_fpl_percent": 200}
    assert got[3] == {"notes": "Income limit 60% of state median income."}
    assert [g["max_annual_income"] for g in (got[4], got[5], got[6], got[11])] == [82450, 32900, 20000, 40000]
    assert all(g == {"notes": "Income limits apply; the amounts are not published on the page."} for g in got[7:9])
    assert got[9] == {} and got[10] == {"max_ami_percent": 80}


def test_people_and_housing(stated):
    risk = ["housed_at_risk", "eviction_notice"]
    got = stated(
        "for low-income veterans", "veterans and their families", "We honor all military veterans for their service.", "to avoid eviction", "received a 3-day notice", "Overnight beds for adults experiencing homelessness.", "Emergency rent for tenants with past due rent to avoid eviction.",
        "homeless families at risk of homelessness", "families receiving CalWORKs", "CalWORKs participants", "Adult Protective Services", "in the child welfare system", "an unlawful detainer case", "Apply for food help and eligibility information.", None, "",
    )
    assert got[0]["requires_veteran"] and got[1] == {"requires_veteran": True} and got[2] == {}
    assert got[3] == {"housing_status_any_of": risk} and got[4] == {"requires_eviction_notice": True}
    assert got[5] == {"housing_status_any_of": ["unhoused"]} and got[6] == {"housing_status_any_of": risk} and got[7] == {"housing_status_any_of": ["unhoused", *risk]}
    aid = "Must be receiving (or applying for) CalWORKs."
    assert got[8] == {"requires_children": True, "notes": aid} and got[9] == {"notes": aid}
    assert [g["notes"] for g in got[10:12]] == ["Must be an Adult Protective Services client or in APS intake.", "Family must be involved with the child welfare system."]
    assert got[12] == {"requires_eviction_notice": True} and got[13:] == [{}, {}, {}]


def test_residents_and_postcodes(stated):
    got = stated(
        "Helps families in the CalWORKs program experiencing homelessness or at risk of homelessness. One must be a resident of Santa Clara County for at least thirty days. Serves zip codes: 95008, 95110, 95111.",
        "zip codes 95112, 95113", "zip code 95112 and 95112", "zip codes " + "x" * 700 + " 95112 95113", "a resident of San Mateo County",
    )
    assert got[0]["requires_children"] and got[0]["housing_status_any_of"] == ["unhoused", "housed_at_risk", "eviction_notice"]
    assert got[0]["notes"] == "Must be receiving (or applying for) CalWORKs. Must be a resident of Santa Clara County for at least thirty days. Serves ZIP codes 95008, 95110, 95111."
    assert got[1:] == [{"notes": "Serves ZIP codes 95112, 95113."}, {}, {}, {"notes": "Must be a resident of San Mateo County."}]
