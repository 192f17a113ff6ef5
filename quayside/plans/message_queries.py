"""Registered queries on messages, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import messages as X
from ..sources.derived import situations, table

MESSAGES = [("en", "income", "You have {amount} a month for {size}."), ("es", "income", "Tiene {amount} al mes para {size}."), ("en", "place", "You live in {place}.")]


def messages_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each situation, in one of three languages; some keys have no message in any."""
    s = situations(spark, sf_dir)
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("sit_id") % 3 + 1).cast("int"))
    params = F.map_from_arrays(F.array(F.lit("amount"), F.lit("size"), F.lit("place")), F.array(X.money(F.col("monthly_income")), F.col("household_size").cast("string"), F.col("location.city")))
    rows = s.select("sit_id", pick("income", "place", "none").alias("key"), F.when(F.col("sit_id") % 2 == 0, "es").otherwise("en").alias("lang"), params.alias("params"))
    return X.translate(rows, spark.createDataFrame(MESSAGES, "lang string, key string, text string")).select("sit_id", "lang", "key", "text")


def messages_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each part in three languages, of which two lack some and have other places in others."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name"))
    both, one = F.concat("p_name", F.lit(": {size} of {brand}, {size} each")), F.concat(F.lit("{brand} "), "p_name")
    text = {"en": both, "es": F.when(F.col("k") % 5 != 0, F.when(F.col("k") % 7 == 0, one).otherwise(F.concat(F.lit("{brand}: {size} "), "p_name"))), "fr": F.when(F.col("k") % 4 != 1, both)}
    rows = [p.select(F.lit(lang).alias("lang"), F.col("k").cast("string").alias("key"), t.alias("text")) for lang, t in text.items()]
    return X.coverage(rows[0].union(rows[1]).union(rows[2]).filter("text is not null"))


def _oracle() -> str:
    from ..sources.derived import SITUATIONS_SQL

    return f"""WITH s AS ({SITUATIONS_SQL}), m AS (SELECT sit_id, CASE WHEN sit_id % 2 = 0 THEN 'es' ELSE 'en' END AS lang, ['income', 'place', 'none'][sit_id % 3 + 1] AS key,
      coalesce('$' || format('{{:,}}', monthly_income::BIGINT), '{{amount}}') AS amount, coalesce(household_size::VARCHAR, '{{size}}') AS size, coalesce(city, '{{place}}') AS place FROM s)
      SELECT sit_id, lang, key, CASE key WHEN 'income' THEN CASE lang WHEN 'es' THEN 'Tiene ' || amount || ' al mes para ' || size || '.' ELSE 'You have ' || amount || ' a month for ' || size || '.' END WHEN 'place' THEN 'You live in ' || place || '.' ELSE 'none' END AS text FROM m"""


COVERAGE = """SELECT 'es' AS lang, p_partkey::VARCHAR AS key, CASE WHEN p_partkey % 5 = 0 THEN 'missing' ELSE 'places' END AS problem FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0
  UNION ALL SELECT 'fr', p_partkey::VARCHAR, 'missing' FROM part WHERE p_partkey % 4 = 1"""

QUERIES = {"messages_fill": messages_fill, "messages_coverage": messages_coverage}
ORACLES = {"messages_fill": _oracle(), "messages_coverage": COVERAGE}
