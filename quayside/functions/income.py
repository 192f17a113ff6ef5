"""Income limits as columns: met, unmet, unverified or none, where an unknown income or household size leaves a question open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dimensions import POVERTY_BASE, POVERTY_STEP, SIZE_FACTORS


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.floor(x + 0.5), 0))


def ami_limit(ami: Column, size: Column, percent: Column) -> Column:
    """Limit by household size, which counts as 1 to 8."""
    at = F.least(F.greatest(size, F.lit(1)), F.lit(8)).cast("int")
    return ami * F.element_at(F.array(*map(F.lit, SIZE_FACTORS)), at) * (percent / 100)


def fpl_limit(size: Column, percent: Column, base: float = POVERTY_BASE, step: float = POVERTY_STEP) -> Column:
    return (F.lit(base) + F.lit(step) * (F.greatest(size, F.lit(1)) - 1)) * (percent / 100)


def bracket(label: Column, income: Column, size: Column, limit: Callable[[Column], Column]) -> Column:
    """struct(status, detail). Without a household size, an income under the limit of one person is met, one above that of eight unmet."""
    annual, own, low, high = income * 12, limit(size), limit(F.lit(1)), limit(F.lit(8))
    say = lambda *parts: F.concat(label, F.lit(": "), *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    row = lambda status, detail: F.struct(F.lit(status).alias("status"), detail.alias("detail"))
    return (
        F.when(income.isNull(), row("unverified", say("income not provided")))
        .when(size.isNotNull() & (annual <= own), row("met", say(money(annual), "/yr is within the ", money(own), "/yr limit for ", size.cast("string"))))
        .when(size.isNotNull(), row("unmet", say(money(annual), "/yr exceeds the ", money(own), "/yr limit for ", size.cast("string"))))
        .when(annual <= low, row("met", say(money(annual), "/yr is under the limit of any household size")))
        .when(annual > high, row("unmet", say(money(annual), "/yr exceeds the limit of any household size")))
        .otherwise(row("unverified", say("depends on the household size, which is not provided")))
    )


#: Codes of a verdict: an unmet limit outweighs an unverified one, and this a met one.
NONE, MET, UNVERIFIED, UNMET = range(4)


def income_code(income: Column, size: Column, ami: Column) -> Column:
    """The code of income_verdict's status, from comparisons alone: what a gate needs for every pair, while details are written for the few that are shown."""
    c = F.col
    annual = income * 12

    def code(limit: Callable[[Column], Column]) -> Column:
        within = F.when(size.isNotNull(), F.when(annual <= limit(size), MET).otherwise(UNMET))
        return F.when(income.isNull(), UNVERIFIED).otherwise(F.coalesce(within, F.when(annual <= limit(F.lit(1)), MET).when(annual > limit(F.lit(8)), UNMET).otherwise(UNVERIFIED)))

    cap = F.when(c("max_annual_income").isNotNull(), code(lambda _: c("max_annual_income")))
    area = F.when(c("max_ami_percent").isNotNull(), F.when(ami.isNull(), UNVERIFIED).otherwise(code(lambda s: ami_limit(ami, s, c("max_ami_percent")))))
    poverty = F.when(c("max_fpl_percent").isNotNull(), code(lambda s: fpl_limit(s, c("max_fpl_percent"))))
    free = F.when(c("income_notes") | ~F.coalesce(c("eligibility_verified"), F.lit(True)), UNVERIFIED).otherwise(NONE)
    return F.coalesce(F.greatest(cap, area, poverty), free)


def status_of(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("none", "met", "unverified", "unmet"))), code + 1)


def income_verdict(income: Column, size: Column, ami: Column) -> Column:
    """struct(status, detail) for the programme columns max_annual_income, max_ami_percent, max_fpl_percent, income_notes, eligibility_verified: the first unmet limit, else the first unverified, else the first."""
    c = F.col
    row = lambda status, detail: F.struct(F.lit(status).alias("status"), F.lit(detail).alias("detail"))
    percent = lambda name: c(name).cast("int").cast("string")
    annual = F.when(c("max_annual_income").isNotNull(), bracket(F.concat(F.lit("Income limit "), money(c("max_annual_income")), F.lit("/yr")), income, size, lambda _: c("max_annual_income")))
    ami_label = F.concat(F.lit("Income limit "), percent("max_ami_percent"), F.lit("% of area median"))
    no_ami = F.struct(F.lit("unverified").alias("status"), F.concat(ami_label, F.lit(": no figure for this area")).alias("detail"))
    area = F.when(c("max_ami_percent").isNotNull(), F.when(ami.isNull(), no_ami).otherwise(bracket(ami_label, income, size, lambda s: ami_limit(ami, s, c("max_ami_percent")))))
    poverty = F.when(c("max_fpl_percent").isNotNull(), bracket(F.concat(F.lit("Income limit "), percent("max_fpl_percent"), F.lit("% of poverty level")), income, size, lambda s: fpl_limit(s, c("max_fpl_percent"))))
    given = F.filter(F.array(annual, area, poverty), lambda v: v.isNotNull())
    pick = lambda status: F.try_element_at(F.filter(given, lambda v: v["status"] == status), F.lit(1))
    none = F.when(c("income_notes"), row("unverified", "Income limits apply; amounts to be confirmed")).when(F.coalesce(c("eligibility_verified"), F.lit(True)), row("none", "No income limit")).otherwise(row("unverified", "Income eligibility not verified"))
    return F.when(F.size(given) == 0, none).otherwise(F.coalesce(pick("unmet"), pick("unverified"), F.element_at(given, 1)))
