"""Rules that a programme's page states in plain words, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import phrases as P
from .text import let, says


def evidence(*parts: Column) -> Column:
    """What a page says, in one line; null parts and empty ones are left out. Arrays count as all their entries."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"[\s ]+", " "))


def found(t: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(t, f"(?i){pattern}", group), F.lit(""))


def eligibility(text: Column) -> Column:
    """struct of caps on income, required children, service, notice and housing status, and notes on what isn't one of these. Only what is said outright counts; what isn't stays null.

    The first form of a yearly cap that a page has counts, if its amount is above 0. That there is some limit is noted only
    where none is named. Postcodes are noted if two or more stand within 600 characters behind their first mention.
    """
    return let(evidence(text), _eligibility)


def _eligibility(t: Column) -> Column:
    caps = F.coalesce(*(found(t, p) for p in P.ANNUAL_INCOMES))
    cap = F.regexp_replace(caps, ",", "").try_cast("double")
    area, poverty, state = (found(t, p) for p in (P.AREA_PERCENT, P.POVERTY_PERCENT, P.STATE_PERCENT))
    true = lambda p: F.when(says(t, p), F.lit(True))
    statuses = lambda *names: F.array(*map(F.lit, names))
    homeless, risk = says(t, P.FOR_HOMELESS), says(t, P.FOR_AT_RISK)
    status = F.when(homeless & risk, statuses("unhoused", "housed_at_risk", "eviction_notice")).when(homeless, statuses("unhoused")).when(risk, statuses("housed_at_risk", "eviction_notice"))
    note = lambda test, key: F.when(test, F.lit(P.NOTES[key]))
    days, county = found(t, P.RESIDENT_OF, 2), F.trim(found(t, P.RESIDENT_OF))
    codes = F.array_distinct(F.regexp_extract_all(F.coalesce(found(t, P.POSTCODES_BEHIND), F.lit("")), F.lit(P.POSTCODE), 0))
    notes = F.array_compact(F.array(
        F.when(state.isNotNull(), F.format_string(P.NOTES["state_percent"], state)),
        note(F.coalesce(caps, area, poverty, state).isNull() & says(t, P.SOME_INCOME_LIMIT), "some_limit"),
        note(says(t, P.CASH_AID_REQUIRED), "cash_aid"), note(says(t, P.ADULT_PROTECTION), "adult_protection"), note(says(t, P.CHILD_WELFARE), "child_welfare"),
        F.when(county.isNotNull(), F.format_string(P.NOTES["resident"], county, F.when(days.isNotNull(), F.format_string(P.NOTES["resident_days"], days)).otherwise(""))),
        F.when(F.size(codes) >= 2, F.format_string(P.NOTES["postcodes"], F.array_join(codes, ", "))),
    ))
    return F.struct(
        F.when(cap > 0, cap).alias("max_annual_income"), area.cast("double").alias("max_ami_percent"), poverty.cast("double").alias("max_fpl_percent"), true(P.VETERANS_ONLY).alias("requires_veteran"), true(P.WITH_CHILDREN).alias("requires_children"),
        true(P.NOTICE_REQUIRED).alias("requires_eviction_notice"), status.alias("housing_status_any_of"), F.nullif(F.array_join(notes, " "), F.lit("")).alias("notes"),
    )
