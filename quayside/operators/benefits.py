"""Benefit estimates of each situation by the figures in force on a date, as one row for each benefit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.income import fpl_limit
from ..sources.dimensions import BENEFIT_LINKS, EARNED_LIMIT, food_years

ORDER = ["calfresh", "medi_cal", "medi_cal_kids", "care", "fera", "wic", "school_meals", "caleitc"]


def as_of_figures(sit: DataFrame, as_of: Column) -> DataFrame:
    """Adds `y`, the food benefit figures in force on as_of; before the first year, those of the first."""
    w = Window.orderBy("effective")
    y = food_years(sit.sparkSession).withColumn("until", F.lead("effective").over(w)).withColumn("first", F.row_number().over(w) == 1)
    day = F.date_format(as_of, "yyyy-MM-dd")
    fields = F.struct(*[c for c in y.columns if c not in ("until", "first")]).alias("y")
    dated = sit.withColumn("_day", day)
    years = y.select("effective", "until", "first", fields)
    fits = ((F.col("effective") <= F.col("_day")) | F.col("first")) & (F.col("until").isNull() | (F.col("_day") < F.col("until")))
    return dated.join(F.broadcast(years), fits).drop("_day", "effective", "until", "first")


def max_allotment(size: Column) -> Column:
    n = F.greatest(size, F.lit(1))
    return F.when(n <= 8, F.element_at("y.allotment", F.least(n, F.lit(8)).cast("int"))).otherwise(F.element_at("y.allotment", 8) + (n - 8) * F.col("y.step"))


def gross_limit(size: Column) -> Column:
    return F.ceil((F.col("y.fpl_base") + F.col("y.fpl_step") * (F.greatest(size, F.lit(1)) - 1)) * 2 / 12)


def food_benefit(size: Column, gross: Column, earned: Column, rent: Column, unknown_rent: str, elderly: Column) -> Column:
    """Allotment less 30 % of net income. Unknown rent counts as none or as the largest deduction. Rounding is half up."""
    deduction = F.element_at("y.deduction", F.when(size <= 3, 1).otherwise(F.least(size - 2, F.lit(4))).cast("int"))
    adjusted = F.greatest(F.lit(0.0), gross - F.lit(0.2) * gross * earned - deduction)
    excess = F.greatest(F.lit(0.0), rent - adjusted / 2)
    known = F.when(elderly, excess).otherwise(F.least(excess, F.col("y.shelter_cap").cast("double")))
    bound = F.lit(0.0) if unknown_rent == "none" else F.when(elderly, adjusted).otherwise(F.col("y.shelter_cap").cast("double"))
    net = F.greatest(F.lit(0.0), adjusted - F.when(rent.isNull(), bound).otherwise(known))
    b = max_allotment(size) - F.floor(F.lit(0.3) * net + 0.5)
    return F.when((gross > gross_limit(size)) | (b <= 0), F.lit(0)).when(size <= 2, F.greatest(b, F.col("y.minimum"))).otherwise(b).cast("double")


def estimates(sit: DataFrame, as_of: Column) -> DataFrame:
    """(sit_id, benefit_id, ord, status, low, high, ceiling) of likely and possible benefits; low, high and ceiling are monthly amounts of the food benefit.

    What income or household size leave open is possible, not likely; unknown facts never rule a benefit out by themselves.
    """
    c = F.col
    d = as_of_figures(sit, as_of)
    income, size, needs = c("monthly_income"), c("household_size"), F.coalesce("needs", F.array().cast("array<string>"))
    pregnant, children = F.coalesce("is_pregnant", F.lit(False)), F.coalesce("has_children", F.lit(False))
    elderly = F.coalesce(c("age") >= 60, F.lit(False)) | F.coalesce(F.arrays_overlap("conditions", F.array(F.lit("disability"), F.lit("mobility_impairment"))), F.lit(False))
    low = food_benefit(size, income, F.when(c("income_source") == "earned", 1).otherwise(0), c("monthly_housing_cost"), "none", elderly)
    high = food_benefit(size, income, F.when(c("income_source") == "unearned", 0).otherwise(1), c("monthly_housing_cost"), "max", elderly)
    open_ = income.isNull() | size.isNull()
    annual = income * 12
    d = d.withColumn("f_low", F.when(~open_, low)).withColumn("f_high", F.when(~open_, high)).withColumn("f_top", F.when(open_, max_allotment(F.coalesce(size, F.lit(1)))).cast("double"))
    food = F.when(open_, "possible").when(c("f_high") > 0, F.when(c("f_low") > 0, "likely").otherwise("possible"))
    food_likely = F.coalesce(food == "likely", F.lit(False))
    family = size + F.when(pregnant, 1).otherwise(0)
    adult = fpl_limit(family, F.when(pregnant, 213.0).otherwise(138.0))
    medical = F.when(open_, F.when(F.array_contains(needs, "health") | pregnant, "possible")).when(annual <= adult, "likely")
    kids = F.when(~open_ & children & (annual <= fpl_limit(family, F.lit(266.0))) & (annual > adult), "likely")
    care_limit = lambda n: fpl_limit(F.greatest(n, F.lit(2)), F.lit(200.0))
    care = (
        F.when(food_likely, "likely").when(income.isNull(), F.when(F.array_contains(needs, "utility"), "possible"))
        .when(size.isNull(), F.when(annual <= care_limit(F.lit(1)), "likely").when(annual <= care_limit(F.lit(8)), "possible")).when(annual <= care_limit(size), "likely")
    )
    fera = F.when(~open_ & ~food_likely & (annual > care_limit(size)) & (size >= 3) & (annual <= fpl_limit(size, F.lit(250.0))), "likely")
    on_program = food_likely | F.coalesce(medical == "likely", F.lit(False)) | kids.isNotNull()
    wic_status = F.when(pregnant, "likely").otherwise("possible")
    wic = F.when(pregnant | children, F.when(on_program, wic_status).when(~open_ & (annual <= fpl_limit(family, F.lit(185.0))), wic_status))
    meals = F.when(children, "likely")
    credit = F.when((income > 0) & c("income_source").isin("earned", "mixed") & (annual <= EARNED_LIMIT), "possible")
    none = F.lit(None).cast("double")
    rows = [
        F.struct(F.lit(b).alias("benefit_id"), F.lit(k).alias("ord"), status.alias("status"), *((c("f_low") if b == "calfresh" else none).alias("low"), (c("f_high") if b == "calfresh" else none).alias("high"), (c("f_top") if b == "calfresh" else none).alias("ceiling")))
        for k, (b, status) in enumerate(zip(ORDER, (food, medical, kids, care, fera, wic, meals, credit), strict=True))
    ]
    return d.select("sit_id", F.explode(F.array(*rows)).alias("e")).filter("e.status is not null").select("sit_id", "e.*")


def totals(sit: DataFrame, as_of: Column) -> DataFrame:
    """(sit_id, likely, possible, low, high, missing): sums over likely benefits with an amount, null without one; missing facts in a fixed order."""
    e = estimates(sit, as_of)
    sums = e.groupBy("sit_id").agg(
        F.sum((F.col("status") == "likely").cast("long")).alias("likely"), F.sum((F.col("status") == "possible").cast("long")).alias("possible"),
        F.sum(F.when(F.col("status") == "likely", F.col("low"))).alias("low"), F.sum(F.when(F.col("status") == "likely", F.col("high"))).alias("high"), F.max((F.col("benefit_id") == "calfresh")).alias("food"),
    )
    gap = lambda name, test: F.when(test, F.lit(name))
    missing = F.array_compact(F.array(gap("income", F.col("monthly_income").isNull()), gap("householdSize", F.col("household_size").isNull()), gap("rent", F.col("monthly_housing_cost").isNull() & F.coalesce("food", F.lit(False)))))
    zero = F.lit(0).cast("long")
    return sit.join(sums, "sit_id", "left").select("sit_id", F.coalesce("likely", zero).alias("likely"), F.coalesce("possible", zero).alias("possible"), "low", "high", F.array_join(missing, ",").alias("missing"))


def applications(sit: DataFrame, as_of: Column) -> DataFrame:
    """(sit_id, benefit_id, ord, status, low, high, ceiling, url, phone, figures): the estimates with where to apply, the telephone if there is one, and the years that the food benefit's figures are of."""
    link = F.create_map(*(x for k, (url, phone) in BENEFIT_LINKS.items() for x in (F.lit(k), F.struct(F.lit(url).alias("url"), F.lit(phone).cast("string").alias("phone")))))
    years = as_of_figures(sit.select("sit_id"), as_of).select("sit_id", F.col("y.label").alias("figures"))
    return estimates(sit, as_of).join(years, "sit_id").withColumn("_at", link[F.col("benefit_id")]).select("sit_id", "benefit_id", "ord", "status", "low", "high", "ceiling", "_at.url", "_at.phone", "figures")
