"""Reviews as they were written: JSON objects of any form, checked key by key, and read into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.dimensions import HOUSING_STATUSES

# What a review may hold, what its eligibility may hold, and the kind of each.
RULE_KINDS = {
    "max_annual_income": "number", "max_ami_percent": "number", "max_fpl_percent": "number", "requires_eviction_notice": "boolean", "requires_children": "boolean", "requires_veteran": "boolean",
    "housing_status_any_of": "housing_statuses", "notes": "string",
}
REVIEW_KEYS = [
    "reviewed_at", "reviewed_by", "active", "eligibility_verified", "eligibility", "phone", "address", "response_time_days", "required_documents", "description", "application_url", "source_url", "exclude", "exclude_reason",
]
#: Kinds of the fields that a review sets; null is allowed where it says so.
FIELD_KINDS = {
    "active": "boolean", "eligibility_verified": "boolean", "phone": "string or null", "address": "string or null", "response_time_days": "number", "required_documents": "strings", "description": "string", "application_url": "string", "source_url": "string",
}


def kind(value: Column) -> Column:
    """object, array, string, boolean, number or null: what a VARIANT holds. A column that is null has none."""
    number = r"^(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
    named = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean"}
    of = lambda t: F.when(t.isin(*named), F.element_at(F.create_map(*(F.lit(x) for pair in named.items() for x in pair)), t)).when(F.startswith(t, F.lit("OBJECT")), "object").when(F.startswith(t, F.lit("ARRAY")), "array").when(t.rlike(number), "number")
    return let(F.schema_of_variant(value), of)


def truthy(value: Column) -> Column:
    """Whether a value counts as given: not missing, null, false, zero or an empty string."""

    def off(k: Column) -> Column:
        return F.when(k == "null", True).when(k == "boolean", ~F.try_variant_get(value, "$", "boolean")).when(k == "string", F.try_variant_get(value, "$", "string") == "").when(k == "number", F.try_variant_get(value, "$", "double") == 0)

    return value.isNotNull() & ~F.coalesce(let(kind(value), off), F.lit(False))


def strict(value: Column, want: str, as_type: str) -> Column:
    """The value if it is of that kind, without any conversion; else null."""
    return F.when(kind(value) == want, F.try_variant_get(value, "$", as_type))


def all_strings(value: Column) -> Column:
    return F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(kind(x) == "string", F.lit(False)))


def at(review: Column, key: str) -> Column:
    return F.try_variant_get(review, f"$.{key}", "variant")


def parsed(reviews: DataFrame) -> DataFrame:
    """reviews(id, json, ...) with `review`, a VARIANT; null where the text is no JSON object."""
    v = F.try_parse_json("json")
    return reviews.withColumn("review", F.when(kind(v) == "object", v))


def entries(df: DataFrame, value: str) -> DataFrame:
    """df with (key, value) for each entry of the objects in a VARIANT column."""
    spark = df.sparkSession
    return df.lateralJoin(spark.tvf.variant_explode(F.col(value).outer())).drop("pos", value)


def rule_error(key: Column, value: Column) -> Column:
    """What is wrong with one entry of an eligibility, null if nothing is."""
    kinds = F.create_map(*(F.lit(x) for pair in RULE_KINDS.items() for x in pair))
    want, is_ = kinds[key], kind(value)
    known = F.array(*map(F.lit, HOUSING_STATUSES))
    statuses = F.try_variant_get(value, "$", "array<string>")
    listed = (is_ == "array") & statuses.isNotNull() & F.forall(statuses, lambda s: F.coalesce(F.array_contains(known, s), F.lit(False)))
    return (
        F.when(want.isNull(), F.concat(F.lit("unknown eligibility field "), key))
        .when(want == "housing_statuses", F.when(~F.coalesce(listed, F.lit(False)), F.concat(F.lit("housing_status_any_of must list only "), F.array_join(known, ", "))))
        .when(is_ != want, F.concat(F.lit("eligibility."), key, F.lit(" must be a "), want))
        .when((want == "number") & ~(F.try_variant_get(value, "$", "double") > 0), F.concat(F.lit("eligibility."), key, F.lit(" must be positive")))
    )


def field_error(key: Column, value: Column) -> Column:
    """What is wrong with one entry of a review, null if nothing is."""
    kinds = F.create_map(*(F.lit(x) for pair in FIELD_KINDS.items() for x in pair))
    want, is_ = kinds[key], kind(value)
    fits = (
        F.when(want == "string or null", is_.isin("string", "null")).when(want == "strings", (is_ == "array") & all_strings(value))
        .when(key == "response_time_days", (is_ == "number") & (F.try_variant_get(value, "$", "double") >= 0)).otherwise(is_ == want)
    )
    said = F.when(want == "string or null", "a string").when(want == "strings", "an array of strings").when(key == "response_time_days", "a non-negative number").otherwise(F.concat(F.lit("a "), want))
    unknown = ~key.isin(REVIEW_KEYS)
    return F.when(unknown, F.concat(F.lit("unknown field "), key)).when(want.isNotNull() & ~F.coalesce(fits, F.lit(False)), F.concat(key, F.lit(" must be "), said))


def review_errors(reviews: DataFrame) -> DataFrame:
    """(id, error) of reviews(id, json): no object at all, keys that no review has, values of the wrong kind, missing dates and names, exclusions without a reason. A review may have several errors; a key that a JSON object repeats makes it unreadable."""
    c = F.col
    p = parsed(reviews.select("id", "json"))
    r = c("review")
    good = p.filter("review is not null").select("id", "review")
    broken = p.filter("review is null").select("id", F.lit("not a JSON object").alias("error"))
    text = lambda key: F.coalesce(truthy(at(r, key)), F.lit(False))
    rules = at(r, "eligibility")
    whole = F.array_compact(F.array(
        F.when(~(text("reviewed_at") & text("reviewed_by")), F.lit("reviewed_at and reviewed_by are required")),
        F.when(truthy(at(r, "exclude")) & ~text("exclude_reason"), F.lit("exclude needs a reason")),
        F.when(truthy(rules) & (kind(rules) != "object"), F.lit("eligibility must be an object")),
    ))
    fields = entries(good, "review").select("id", field_error(c("key"), c("value")).alias("error"))
    stated = good.select("id", F.when(kind(rules) == "object", rules).alias("rules")).filter("rules is not null")
    inner = entries(stated, "rules").filter("key is not null").select("id", rule_error(c("key"), c("value")).alias("error"))
    named = broken.unionByName(good.select("id", F.explode(whole).alias("error"))).unionByName(fields).unionByName(inner).filter("error is not null")
    return named.select(F.concat(F.lit("override "), "id").alias("id"), "error")


def typed_reviews(reviews: DataFrame) -> DataFrame:
    """(id, ord, reviewed_at, ..., rules): reviews(id, ord, json) as promote() takes them. What is missing or of the wrong kind is null; what is no JSON object is left out."""
    r, rules = F.col("review"), at(F.col("review"), "eligibility")
    types = {"string": "string", "boolean": "boolean", "number": "double"}
    get = lambda key, want: strict(at(r, key), want, types[want]).alias(key)
    strings = lambda value: F.when((kind(value) == "array") & all_strings(value), F.try_variant_get(value, "$", "array<string>"))
    rule = lambda key, want: (strings(at(rules, key)) if want == "housing_statuses" else strict(at(rules, key), want, types[want])).alias(key)
    texts = ["phone", "address", "description", "application_url", "source_url"]
    return parsed(reviews).filter("review is not null").select(
        "id", "ord", get("reviewed_at", "string"), get("reviewed_by", "string"), truthy(at(r, "exclude")).alias("exclude"), get("exclude_reason", "string"), get("eligibility_verified", "boolean"),
        F.when(kind(rules) == "object", F.struct(*(rule(k, w) for k, w in RULE_KINDS.items()))).alias("rules"),
        get("active", "boolean"), get("response_time_days", "number").cast("int").alias("response_time_days"), strings(at(r, "required_documents")).alias("required_documents"), *(get(k, "string") for k in texts),
    )
