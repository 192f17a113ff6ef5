"""Situations that something else has read from a text: what is outside the lists and limits goes, and what the text says outright is kept beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import crisis
from ..sources.dimensions import HOUSING_STATUSES
from ..sources.phrases import CONDITIONS
from .catalogue import known_needs

# Limits of numbers, and the sources of income.
LEAST_SIZE, YOUNGEST, OLDEST, INCOME_SOURCES = 1, 14, 110, ["earned", "unearned", "mixed"]
SCALARS = ["household_size", "monthly_income", "income_source", "monthly_housing_cost", "age", "housing_status", "has_children", "is_veteran", "is_pregnant"]


def rounded(x: Column, test: Column, kind: str) -> Column:
    """The number, halves up, if the test holds; NaN and infinite values never count."""
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite & test, F.floor(x + 0.5)).cast(kind)


def known_conditions(conditions: Column) -> Column:
    """The conditions of the list, each once, in order; null as none."""
    return F.array_distinct(F.filter(F.coalesce(conditions, F.array().cast("array<string>")), lambda c: F.coalesce(c.isin(*CONDITIONS), F.lit(False))))


def guarded(given: DataFrame) -> DataFrame:
    """given(key, SCALARS..., needs, conditions) with what lies outside the lists and limits null or left out, and other columns as they are. A list of which nothing is left is null; false doesn't tell that someone isn't pregnant."""
    c = F.col
    some = lambda a: F.when(F.size(a) > 0, a)
    number = lambda name: c(name).cast("double")
    return given.withColumns({
        "household_size": rounded(number("household_size"), number("household_size") >= LEAST_SIZE, "int"), "monthly_income": rounded(number("monthly_income"), number("monthly_income") >= 0, "double"),
        "income_source": F.when(c("income_source").isin(INCOME_SOURCES), c("income_source")), "monthly_housing_cost": rounded(number("monthly_housing_cost"), number("monthly_housing_cost") > 0, "double"),
        "age": rounded(number("age"), number("age").between(YOUNGEST, OLDEST), "int"), "housing_status": F.when(c("housing_status").isin(HOUSING_STATUSES), c("housing_status")), "is_pregnant": F.when(c("is_pregnant"), F.lit(True)),
        "needs": some(known_needs(c("needs"))), "conditions": some(known_conditions(c("conditions"))),
    })


def with_text(given: DataFrame, read: DataFrame) -> DataFrame:
    """(key, SCALARS..., needs, conditions) of each row of read, what the texts say: facts of guarded(given) win, lists are joined, those of the text first. Rows of given without a text are left out; of several for one key each makes a row."""
    g = guarded(given).select("key", *(F.col(x).alias(f"_{x}") for x in (*SCALARS, "needs", "conditions")))
    both = read.join(g, "key", "left")
    none = F.array().cast("array<string>")
    union = lambda x: F.array_union(F.coalesce(F.col(x), none), F.coalesce(F.col(f"_{x}"), none)).alias(x)
    return both.select("key", *(F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) for x in SCALARS), union("needs"), union("conditions"))


def immediate_safety(stored: Column, text: Column) -> Column:
    """Whether someone should be called at once: there are stored signs, or the text has one. Nulls are none."""
    return (F.size(F.coalesce(stored, F.array().cast("array<string>"))) > 0) | F.coalesce(crisis(text), F.lit(False))
