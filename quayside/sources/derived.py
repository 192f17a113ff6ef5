"""Situations and a catalogue of programmes derived from the whole driver tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dimensions import CATEGORIES

#: One situation for each customer. A remainder that no branch names leaves a fact unknown.
SITUATIONS_SQL = """
SELECT c_custkey AS sit_id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1 + c_custkey % 9 END AS household_size,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 0 ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) END AS monthly_income,
  CASE c_custkey % 4 WHEN 1 THEN 'earned' WHEN 2 THEN 'unearned' WHEN 3 THEN 'mixed' END AS income_source,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 800 + (c_custkey * 37) % 2400 END AS monthly_housing_cost,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 18 + (c_custkey * 7) % 70 END AS age,
  CASE (c_custkey * 3 + c_nationkey) % 5 WHEN 1 THEN 'housed_stable' WHEN 2 THEN 'housed_at_risk' WHEN 3 THEN 'eviction_notice' WHEN 4 THEN 'unhoused' END AS housing_status,
  CASE (c_custkey + c_nationkey) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_children,
  CASE c_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS is_veteran,
  CASE WHEN c_custkey % 13 = 0 THEN true END AS is_pregnant,
  CASE c_nationkey % 6 WHEN 0 THEN 'Santa Clara County' WHEN 1 THEN 'San Mateo County' WHEN 2 THEN 'Alameda County' WHEN 3 THEN 'Santa Clara County' WHEN 4 THEN 'Kern County' END AS county,
  CASE c_nationkey % 6 WHEN 0 THEN 'San Jose' WHEN 1 THEN 'Redwood City' WHEN 2 THEN 'Oakland' END AS city,
  CASE c_nationkey % 6 WHEN 0 THEN 37.3382e0 WHEN 1 THEN 37.4852e0 WHEN 2 THEN 37.8044e0 END AS lat,
  CASE c_nationkey % 6 WHEN 0 THEN -121.8863e0 WHEN 1 THEN -122.2364e0 WHEN 2 THEN -122.2712e0 END AS lng,
  CASE WHEN c_custkey % 16 = 15 THEN NULL ELSE c_custkey % 16 END AS need1_no,
  CASE WHEN c_custkey % 16 = 15 OR c_custkey % 2 = 0 THEN NULL ELSE (c_custkey * 7 + 3) % 15 END AS need2_no,
  CASE c_custkey % 4 WHEN 1 THEN 'photo id' WHEN 2 THEN 'Lease' END AS doc_held
FROM customer
"""

#: One programme for each supplier.
CATALOGUE_SQL = """
SELECT concat('r', CAST(k AS VARCHAR(20))) AS id, k AS ord, concat('program ', CAST(100 + k * 7 % 64 AS VARCHAR(20))) AS name, concat('org ', CAST(k % 11 AS VARCHAR(20))) AS organization,
  k % 15 AS category_no,
  CASE k % 8 WHEN 0 THEN 'US' WHEN 1 THEN 'California' WHEN 2 THEN 'Santa Clara County, CA' WHEN 3 THEN 'San Mateo County, CA'
       WHEN 4 THEN 'Santa Clara and San Mateo counties, CA' WHEN 5 THEN 'San Jose, CA' WHEN 6 THEN 'Alameda County, CA' ELSE 'Oakland, CA' END AS area1,
  CASE WHEN k % 10 = 3 THEN 'Redwood City, CA' END AS area2,
  k % 17 <> 0 AS active, k % 3 <> 0 AS eligibility_verified,
  CASE z % 5 WHEN 0 THEN 50 WHEN 1 THEN 80 END AS max_ami_percent,
  CASE WHEN z % 7 = 0 THEN 200 END AS max_fpl_percent,
  CASE WHEN z % 11 = 0 THEN 32900 END AS max_annual_income,
  CASE WHEN z % 13 = 0 THEN true WHEN z % 13 = 1 THEN false END AS requires_eviction_notice,
  CASE WHEN z % 6 = 2 THEN true END AS requires_children,
  CASE WHEN k % 19 = 4 THEN true END AS requires_veteran,
  CASE WHEN z % 9 = 3 THEN 'unhoused' WHEN z % 9 = 4 THEN 'housed_at_risk' END AS status_any1,
  CASE WHEN z % 9 = 4 THEN 'eviction_notice' END AS status_any2,
  CASE WHEN k % 12 = 5 THEN 'Low income residents.' WHEN k % 12 = 7 THEN 'Must have a lease.' END AS notes,
  CASE k % 4 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 30 END AS response_time_days,
  CASE WHEN k % 5 = 1 THEN 'Photo ID' WHEN k % 5 = 2 THEN 'Lease' END AS doc1,
  CASE WHEN k % 10 = 1 THEN 'Proof of address' END AS doc2,
  CASE k % 8 WHEN 2 THEN 37.3382e0 WHEN 3 THEN 37.4852e0 WHEN 5 THEN 37.3382e0 WHEN 7 THEN 37.8044e0 END AS lat,
  CASE k % 8 WHEN 2 THEN -121.8863e0 WHEN 3 THEN -122.2364e0 WHEN 5 THEN -121.8863e0 WHEN 7 THEN -122.2712e0 END AS lng
FROM (SELECT s_suppkey AS k, 1 + (s_suppkey * 7 + s_nationkey) % 50 AS z FROM supplier) s
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key, so that a small file, whose rows cost much each, isn't one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def numbered(names: list[str], no):
    return F.when(no.isNotNull(), F.element_at(F.array(*map(F.lit, names)), (no + 1).cast("int")))


def some(*cols):
    """An array of those that aren't null."""
    return F.filter(F.array(*cols), lambda x: x.isNotNull())


def situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql(SITUATIONS_SQL.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    place = F.struct("city", "county", F.lit(None).cast("string").alias("zip"), "lat", "lng")
    return s.select(
        "sit_id", F.col("household_size").cast("int").alias("household_size"), F.col("monthly_income").cast("double").alias("monthly_income"), "income_source",
        F.col("monthly_housing_cost").cast("double").alias("monthly_housing_cost"), F.col("age").cast("int").alias("age"), "housing_status", "has_children", "is_veteran", "is_pregnant",
        F.when(F.col("county").isNotNull(), place).alias("location"),
        F.array_distinct(some(numbered(CATEGORIES, F.col("need1_no")), numbered(CATEGORIES, F.col("need2_no")))).alias("needs"),
        F.when(F.col("doc_held").isNotNull(), F.array("doc_held")).alias("documents_available"), F.array().cast("array<string>").alias("conditions"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.sql(CATALOGUE_SQL.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    return c.select(
        "id", "ord", "name", "organization", numbered(CATEGORIES, F.col("category_no")).alias("category"), some("area1", "area2").alias("service_area"), "active", "eligibility_verified",
        *(F.col(x).cast("double").alias(x) for x in ("max_annual_income", "max_ami_percent", "max_fpl_percent")), "requires_eviction_notice", "requires_children", "requires_veteran",
        F.when(F.col("status_any1").isNotNull(), some("status_any1", "status_any2")).alias("housing_status_any_of"), "notes", some("doc1", "doc2").alias("required_documents"),
        F.col("response_time_days").cast("int").alias("response_time_days"), "lat", "lng",
    )
