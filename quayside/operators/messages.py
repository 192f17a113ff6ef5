"""Messages by key and language, with their places filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.floor(amount + 0.5), 0))


def fill(text: Column, params: Column) -> Column:
    """text with {name} replaced by the value of each entry of the map params; names without a value stay."""
    entries = F.coalesce(F.map_entries(params), F.array().cast("array<struct<key:string,value:string>>"))
    return F.aggregate(entries, text, lambda t, e: F.coalesce(F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]), t))


def translate(rows: DataFrame, messages: DataFrame, fallback: str = "en") -> DataFrame:
    """rows(key, lang, params, ...) with `text`: the message in the language, else in the fallback, else the key itself, filled in. messages(lang, key, text) has the size of a vocabulary and is broadcast."""
    own = messages.select(F.col("lang").alias("_lang"), F.col("key").alias("_key"), F.col("text").alias("_text"))
    other = messages.filter(F.col("lang") == fallback).select(F.col("key").alias("_fkey"), F.col("text").alias("_ftext"))
    out = rows.join(F.broadcast(own), (F.col("lang") == F.col("_lang")) & (F.col("key") == F.col("_key")), "left").join(F.broadcast(other), F.col("key") == F.col("_fkey"), "left")
    return out.withColumn("text", fill(F.coalesce("_text", "_ftext", "key"), F.col("params"))).drop("_lang", "_key", "_text", "_fkey", "_ftext")


def coverage(messages: DataFrame, fallback: str = "en") -> DataFrame:
    """(lang, key, problem): messages of the fallback language that another language lacks, or has with other places to fill in."""
    places = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{(\w+)\}"), 1)))
    m = messages.select("lang", "key", places.alias("places"))
    base = m.filter(F.col("lang") == fallback).select("key", F.col("places").alias("want"))
    langs = m.select("lang").distinct().filter(F.col("lang") != fallback)
    every = langs.crossJoin(base)  # languages are few, messages a vocabulary
    both = every.join(m, ["lang", "key"], "left")
    problem = F.when(F.col("places").isNull(), "missing").when(F.col("places") != F.col("want"), "places")
    return both.select("lang", "key", problem.alias("problem")).filter("problem is not null")
