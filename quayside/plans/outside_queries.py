"""Registered queries on situations from outside, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outside as O
from ..sources.derived import table
from .text_queries import texts

#: What something else read for each customer; remainders plant what is outside lists and limits.
_GIVEN = """
SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 0.4e0 WHEN 1 THEN 2.5e0 WHEN 2 THEN -3e0 END AS household_size, CASE c_custkey % 5 WHEN 0 THEN -1e0 WHEN 1 THEN 0e0 WHEN 2 THEN 1200.5e0 END AS monthly_income,
  CASE c_custkey % 3 WHEN 0 THEN 'earned' WHEN 1 THEN 'stolen' END AS income_source, CASE c_custkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 999.5e0 END AS monthly_housing_cost, CASE c_custkey % 6 WHEN 0 THEN 13.6e0 WHEN 1 THEN 14e0 WHEN 2 THEN 110.4e0 WHEN 3 THEN 70e0 END AS age,
  CASE c_custkey % 3 WHEN 1 THEN 'unhoused' WHEN 2 THEN 'castle' END AS housing_status, CASE c_custkey % 2 WHEN 0 THEN true END AS has_children, CASE c_custkey % 3 WHEN 0 THEN false END AS is_veteran, c_custkey % 2 = 0 AS is_pregnant,
  CASE c_custkey % 4 WHEN 0 THEN 'food,gold,food' WHEN 1 THEN 'gold' WHEN 2 THEN 'legal,food' END AS needs, CASE c_custkey % 3 WHEN 0 THEN 'cancer,luck' WHEN 1 THEN 'luck' END AS conditions
FROM customer
"""


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.sql(_GIVEN.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return g.withColumns({k: F.split(k, ",") for k in ("needs", "conditions")})


def outside_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = O.guarded(_given(spark, sf_dir))
    return g.select("key", *O.SCALARS, F.array_join("needs", ",").alias("needs"), F.array_join("conditions", ",").alias("conditions"))


def immediate_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third situation has a stored sign; texts have or deny one by their number."""
    stored = F.when(F.col("key") % 3 == 0, F.array(F.lit("stored"))).when(F.col("key") % 3 == 1, F.array().cast("array<string>"))
    return texts(spark, sf_dir).select("key", O.immediate_safety(stored, F.col("text")).alias("at_once"))


ORACLES = {
    "outside_guarded": f"""WITH g AS ({_GIVEN}) SELECT key, CASE WHEN key % 4 = 1 THEN 3 END AS household_size, CASE key % 5 WHEN 1 THEN 0::DOUBLE WHEN 2 THEN 1201::DOUBLE END AS monthly_income, CASE WHEN key % 3 = 0 THEN 'earned' END AS income_source, CASE WHEN key % 4 = 1 THEN 1000::DOUBLE END AS monthly_housing_cost,
      CASE key % 6 WHEN 1 THEN 14 WHEN 3 THEN 70 END AS age, CASE WHEN key % 3 = 1 THEN 'unhoused' END AS housing_status, has_children, is_veteran, CASE WHEN is_pregnant THEN true END AS is_pregnant, CASE key % 4 WHEN 0 THEN 'food' WHEN 2 THEN 'legal,food' END AS needs, CASE WHEN key % 3 = 0 THEN 'cancer' END AS conditions FROM g""",
    "immediate_safety": "SELECT c_custkey AS key, c_custkey % 3 = 0 OR c_custkey % 5 = 1 AS at_once FROM customer",
}

QUERIES = {f.__name__: f for f in (outside_guarded, immediate_safety)}
