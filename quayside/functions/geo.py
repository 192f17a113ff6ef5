"""Service areas, places and distances as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the whole country and of the state.
NATIONAL = ["us", "usa", "national", "nationwide", "united states"]
STATE = ["ca", "california"]
EARTH_MILES = 3958.8


def norm(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(s, F.lit("")))), r"\s+", " ")


def norm_county(s: Column) -> Column:
    return F.regexp_replace(norm(s), r"\s+count(?:y|ies)$", "")


def parse_area(entry: Column) -> Column:
    """struct(kind, place, counties): an entry without a comma is a state unless it is national; "A and B counties" names two."""
    n = norm(entry)
    place = F.trim(F.regexp_replace(n, r"\s*,[^,]*$", ""))
    county = place.rlike(r"\bcount(?:y|ies)$")
    kind = F.when(n.isin(NATIONAL), "national").when(~F.contains(n, F.lit(",")), "state").when(county, "county").otherwise("city")
    counties = F.when(kind == "county", F.transform(F.split(norm_county(place), r"\s+and\s+"), lambda c: F.trim(c)))
    return F.struct(kind.alias("kind"), place.alias("place"), counties.alias("counties"))


def match_area(area: Column, has_location: Column, county: Column, city: Column) -> Column:
    """match, mismatch or unknown of one parsed entry; county and city are normalised, empty if unknown. The state of counties and cities isn't compared."""
    return (
        F.when(area["kind"] == "national", "match")
        .when(area["kind"] == "state", F.when(has_location & area["place"].isin(STATE), "match").otherwise("unknown"))
        .when(area["kind"] == "county", F.when(county == "", "unknown").when(F.array_contains(area["counties"], county), "match").otherwise("mismatch"))
        .otherwise(F.when(city == "", "unknown").when(city == area["place"], "match").otherwise("mismatch"))
    )


def distance_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(h))


def prepare_catalogue(cat: DataFrame) -> DataFrame:
    """Adds what depends on the programme alone: parsed areas, flags, lower-case documents."""
    return (
        cat.withColumn("areas", F.transform("service_area", parse_area))
        .withColumn("national", F.exists("areas", lambda a: a["kind"] == "national"))
        .withColumn("statewide", F.exists("areas", lambda a: a["kind"] == "state"))
        .withColumn("income_notes", F.coalesce(F.col("notes").rlike(r"(?i)\bincome\b"), F.lit(False)))
        .withColumn("required_lower", F.transform("required_documents", lambda d: F.lower(d)))
    )


def location_columns(sit: DataFrame) -> DataFrame:
    """Adds has_location, normalised county and city, coordinates, and place_key, which is equal for situations of the same county and city. A location without any field still is one."""
    loc = F.col("location")
    out = sit.withColumn("has_location", loc.isNotNull()).withColumn("u_county", norm_county(loc["county"])).withColumn("u_city", norm(loc["city"])).withColumn("u_lat", loc["lat"]).withColumn("u_lng", loc["lng"])
    return out.withColumn("place_key", F.concat_ws("|", *(F.col(c).cast("string") for c in ("has_location", "u_county", "u_city"))))


def area_table(sit: DataFrame, cat: DataFrame) -> DataFrame:
    """A row for each distinct county and city, and programme: all programme columns, area verdict, first matched entry.

    Verdicts depend on names alone, and there are few of these however many people there are; each has coordinates of its
    own, and miles are worked out for a pair.
    """
    at = sit.select("place_key", "has_location", "u_county", "u_city").dropDuplicates(["place_key"])
    both = at.crossJoin(cat)
    verdicts = F.transform("areas", lambda a: match_area(a, F.col("has_location"), F.col("u_county"), F.col("u_city")))
    v = both.withColumn("_v", verdicts)
    first = F.element_at(F.col("service_area"), F.array_position("_v", F.lit("match")).cast("int"))
    verdict = F.when(F.array_contains("_v", "match"), "match").when((F.size("_v") == 0) | F.array_contains("_v", "unknown"), "unknown").otherwise("mismatch")
    return v.withColumn("area_verdict", verdict).withColumn("area_matched", F.when(F.array_contains("_v", "match"), first)).drop("_v", "has_location", "u_county", "u_city", "areas")
