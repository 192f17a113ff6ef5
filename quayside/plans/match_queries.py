"""Registered queries on matching, with their DuckDB equivalents over the same derived inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match as M
from ..sources.derived import CATALOGUE_SQL, SITUATIONS_SQL, catalogue, situations
from ..sources.dimensions import CATEGORIES, MEDIAN_INCOME, RELATED, RELATED_LIMIT, SIZE_FACTORS


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return situations(spark, sf_dir), catalogue(spark, sf_dir)


def match_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gate_failures(*_both(spark, sf_dir))


def match_excluded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.excluded_counts(*_both(spark, sf_dir))


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.plan_counts(*_both(spark, sf_dir))


def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.survivor_scores(*_both(spark, sf_dir)).withColumn("needs_verification", F.col("unverified") > 0)


def match_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ranking(*_both(spark, sf_dir), 0)[0].select("sit_id", "rank", "id", "score")


def match_related_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best(*_both(spark, sf_dir), 0, RELATED_LIMIT).select("sit_id", "rank", "id", "score")


def match_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and statuses summed by factor."""
    return M.breakdown_totals(*_both(spark, sf_dir))


def distance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.distance_counts(*_both(spark, sf_dir)).withColumn("most", F.round("most", 6))


def income_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.income_counts(*_both(spark, sf_dir))


def docs_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.missing_counts(*_both(spark, sf_dir))


# -- equivalents -------------------------------------------------------------


def _area(a: str) -> str:
    return f"""CASE WHEN {a} IS NULL THEN NULL WHEN {a} = 'US' THEN 'match' WHEN {a} = 'California' THEN CASE WHEN county IS NOT NULL THEN 'match' ELSE 'unknown' END
    WHEN {a} LIKE '%ount%' THEN CASE WHEN county IS NULL THEN 'unknown' WHEN contains({a}, replace(county, ' County', '')) THEN 'match' ELSE 'mismatch' END
    ELSE CASE WHEN city IS NULL THEN 'unknown' WHEN city || ', CA' = {a} THEN 'match' ELSE 'mismatch' END END"""


def _bracket(given: str, own: str, low: str, high: str) -> str:
    return f"""CASE WHEN {given} IS NULL THEN NULL WHEN monthly_income IS NULL THEN 'unverified'
    WHEN household_size IS NOT NULL THEN CASE WHEN monthly_income * 12 <= {own} THEN 'met' ELSE 'unmet' END
    WHEN monthly_income * 12 <= {low} THEN 'met' WHEN monthly_income * 12 > {high} THEN 'unmet' ELSE 'unverified' END"""


_AMI = "CASE lower(county) " + " ".join(f"WHEN '{k}' THEN {v:.1f}::DOUBLE" for k, v in MEDIAN_INCOME.items()) + " END"
_FACTOR = "[" + ", ".join(f"{x}::DOUBLE" for x in SIZE_FACTORS) + "]"
_ami = lambda size: f"ami * ({_FACTOR})[least(greatest({size}, 1), 8)] * (max_ami_percent / 100.0::DOUBLE)"
_fpl = lambda size: f"(15650.0::DOUBLE + 5500.0::DOUBLE * (greatest({size}, 1) - 1)) * (max_fpl_percent / 100.0::DOUBLE)"
_NAMES = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
_RELATED = "CASE category " + " ".join("WHEN '{}' THEN [{}]".format(c, ", ".join(f"'{k}'" for k, v in RELATED.items() if c in v)) for c in CATEGORIES) + " END"

PAIRS_SQL = f"""
s AS ({SITUATIONS_SQL}),
c AS ({CATALOGUE_SQL}),
x AS (
  SELECT s.* EXCLUDE (lat, lng), s.lat AS ulat, s.lng AS ulng, c.*, {_AMI} AS ami, ({_NAMES})[category_no + 1] AS category, ({_NAMES})[need1_no + 1] AS need1, ({_NAMES})[need2_no + 1] AS need2,
    {_area("area1")} AS v1, {_area("area2")} AS v2
  FROM s CROSS JOIN c),
y AS (
  SELECT *, CASE WHEN v1 = 'match' OR v2 = 'match' THEN 'match' WHEN v1 = 'unknown' OR v2 = 'unknown' THEN 'unknown' ELSE 'mismatch' END AS area,
    {_bracket("max_annual_income", "max_annual_income", "max_annual_income", "max_annual_income")} AS i1,
    CASE WHEN max_ami_percent IS NOT NULL AND ami IS NULL THEN 'unverified' ELSE {_bracket("max_ami_percent", _ami("household_size"), _ami("1"), _ami("8"))} END AS i2,
    {_bracket("max_fpl_percent", _fpl("household_size"), _fpl("1"), _fpl("8"))} AS i3,
    7917.6::DOUBLE * asin(sqrt(pow(sin(radians(lat - ulat) / 2), 2) + cos(radians(ulat)) * cos(radians(lat)) * pow(sin(radians(lng - ulng) / 2), 2))) AS miles
  FROM x),
p AS (
  SELECT *, CASE WHEN 'unmet' IN (i1, i2, i3) THEN 'unmet' WHEN 'unverified' IN (coalesce(i1, ''), coalesce(i2, ''), coalesce(i3, '')) THEN 'unverified' WHEN 'met' IN (coalesce(i1, ''), coalesce(i2, ''), coalesce(i3, '')) THEN 'met'
    WHEN notes = 'Low income residents.' THEN 'unverified' WHEN eligibility_verified THEN 'none' ELSE 'unverified' END AS income
  FROM (SELECT * REPLACE (coalesce(i1, '') AS i1, coalesce(i2, '') AS i2, coalesce(i3, '') AS i3) FROM y)),
g AS (
  SELECT *, NOT active AS f1, area = 'mismatch' AS f2, income = 'unmet' AS f3, coalesce(requires_eviction_notice AND housing_status <> 'eviction_notice', false) AS f4,
    coalesce(requires_children AND NOT has_children, false) AS f5, coalesce(requires_veteran AND NOT is_veteran, false) AS f6,
    coalesce(status_any1 IS NOT NULL AND housing_status NOT IN (status_any1, coalesce(status_any2, '')), false) AS f7 FROM p),
sc AS (
  SELECT *, CASE WHEN need1 IS NULL AND need2 IS NULL THEN 'ranked' WHEN category = need1 OR category = need2 THEN 'ranked'
      WHEN list_contains({_RELATED}, need1) OR list_contains({_RELATED}, need2) THEN 'related' END AS section,
    housing_status IN ('eviction_notice', 'unhoused') AS urgent
  FROM g WHERE NOT (f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7)),
sd AS (
  SELECT *,
    CASE WHEN area = 'match' THEN 15 ELSE 0 END + CASE WHEN category IN (coalesce(need1, ''), coalesce(need2, '')) THEN 30 ELSE 0 END
    + CASE WHEN urgent AND response_time_days <= 7 THEN 15 ELSE 0 END + CASE income WHEN 'none' THEN 10 WHEN 'met' THEN 20 ELSE 0 END
    + CASE WHEN requires_eviction_notice AND housing_status = 'eviction_notice' THEN 10 ELSE 0 END + CASE WHEN requires_children AND has_children THEN 10 ELSE 0 END
    + CASE WHEN requires_veteran AND is_veteran THEN 10 ELSE 0 END + CASE WHEN status_any1 IS NOT NULL AND housing_status IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN coalesce(doc1, doc2) IS NOT NULL AND doc_held IS NOT NULL AND coalesce(lower(doc1) = lower(doc_held), true) AND coalesce(lower(doc2) = lower(doc_held), true) THEN 10 ELSE 0 END
    + CASE WHEN area1 IN ('US', 'California') OR miles IS NULL THEN 0 WHEN miles <= 5 THEN 10 WHEN miles <= 15 THEN 5 ELSE 0 END AS score,
    (area <> 'match')::INT + (need1 IS NULL AND need2 IS NULL)::INT + (income = 'unverified')::INT + coalesce(requires_eviction_notice AND housing_status IS NULL, false)::INT
    + coalesce(requires_children AND has_children IS NULL, false)::INT + coalesce(requires_veteran AND is_veteran IS NULL, false)::INT
    + (status_any1 IS NOT NULL AND housing_status IS NULL)::INT + (notes IS NOT NULL)::INT AS unverified
  FROM sc WHERE section IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY sit_id, section ORDER BY score DESC, unverified, name, ord) AS rank FROM sd)"""

_GATES = ", ".join(f"CASE WHEN f{k + 1} THEN '{gate}' END" for k, gate in enumerate(M.GATES))
_FAILED = "f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7"

ORACLES = {
    "match_gates": f"WITH {PAIRS_SQL} SELECT sit_id, id, concat_ws(',', {_GATES}) AS gates FROM g WHERE {_FAILED}",
    "match_excluded_counts": f"WITH {PAIRS_SQL} SELECT sit_id, sum(({_FAILED})::INT)::BIGINT AS excluded, " + ", ".join(f"sum(f{k + 1}::INT)::BIGINT AS by_{gate}" for k, gate in enumerate(M.GATES)) + " FROM g GROUP BY sit_id",
    "match_counts": f"""WITH {PAIRS_SQL}, k AS (SELECT sc.sit_id, sc.section, sd.unverified FROM sc LEFT JOIN sd ON sd.sit_id = sc.sit_id AND sd.id = sc.id)
      SELECT s.sit_id, count(k.sit_id) AS survivors, count_if(section = 'ranked')::BIGINT AS ranked, count_if(section = 'related')::BIGINT AS related, count_if(section = 'ranked' AND unverified = 0)::BIGINT AS confirmed FROM s LEFT JOIN k ON k.sit_id = s.sit_id GROUP BY s.sit_id""",
    "match_scores": f"WITH {PAIRS_SQL} SELECT sit_id, id, section, score, unverified, unverified > 0 AS needs_verification FROM sd",
    "match_rank": f"WITH {PAIRS_SQL} SELECT sit_id, rank, id, score FROM r WHERE section = 'ranked'",
    "match_related_topk": f"WITH {PAIRS_SQL} SELECT sit_id, rank, id, score FROM r WHERE section = 'related' AND rank <= 6",
    "match_breakdown": f"""WITH {PAIRS_SQL}, k AS (SELECT * FROM r WHERE section = 'ranked' OR rank <= 6), b AS (
      SELECT 'service_area' AS factor, CASE WHEN area = 'match' THEN 'met' ELSE 'unverified' END AS status, CASE WHEN area = 'match' THEN 15 ELSE 0 END AS points FROM k
      UNION ALL SELECT 'need_match', CASE WHEN need1 IS NULL AND need2 IS NULL THEN 'unverified' WHEN category IN (coalesce(need1, ''), coalesce(need2, '')) THEN 'met' ELSE 'unmet' END, CASE WHEN category IN (coalesce(need1, ''), coalesce(need2, '')) THEN 30 ELSE 0 END FROM k
      UNION ALL SELECT 'urgency_fit', CASE WHEN housing_status IS NULL THEN 'unverified' WHEN NOT urgent OR response_time_days <= 7 THEN 'met' ELSE 'unmet' END, CASE WHEN urgent AND response_time_days <= 7 THEN 15 ELSE 0 END FROM k WHERE housing_status IS NULL OR response_time_days IS NOT NULL
      UNION ALL SELECT 'income_limit', CASE WHEN income IN ('none', 'met') THEN 'met' ELSE 'unverified' END, CASE income WHEN 'none' THEN 10 WHEN 'met' THEN 20 ELSE 0 END FROM k
      UNION ALL SELECT 'eviction_notice', CASE WHEN housing_status = 'eviction_notice' THEN 'met' ELSE 'unverified' END, CASE WHEN housing_status = 'eviction_notice' THEN 10 ELSE 0 END FROM k WHERE requires_eviction_notice
      UNION ALL SELECT 'children', CASE WHEN has_children THEN 'met' ELSE 'unverified' END, CASE WHEN has_children THEN 10 ELSE 0 END FROM k WHERE requires_children
      UNION ALL SELECT 'veteran', CASE WHEN is_veteran THEN 'met' ELSE 'unverified' END, CASE WHEN is_veteran THEN 10 ELSE 0 END FROM k WHERE requires_veteran
      UNION ALL SELECT 'housing_status', CASE WHEN housing_status IS NOT NULL THEN 'met' ELSE 'unverified' END, CASE WHEN housing_status IS NOT NULL THEN 10 ELSE 0 END FROM k WHERE status_any1 IS NOT NULL
      UNION ALL SELECT 'other_conditions', 'unverified', 0 FROM k WHERE notes IS NOT NULL
      UNION ALL SELECT 'documents', CASE WHEN doc_held IS NULL THEN 'unverified' WHEN coalesce(lower(doc1) = lower(doc_held), true) AND coalesce(lower(doc2) = lower(doc_held), true) THEN 'met' ELSE 'unmet' END,
        CASE WHEN doc_held IS NOT NULL AND coalesce(lower(doc1) = lower(doc_held), true) AND coalesce(lower(doc2) = lower(doc_held), true) THEN 10 ELSE 0 END FROM k WHERE coalesce(doc1, doc2) IS NOT NULL
      UNION ALL SELECT 'distance', CASE WHEN area1 IN ('US', 'California') OR miles IS NOT NULL THEN 'met' ELSE 'unverified' END, CASE WHEN area1 IN ('US', 'California') OR miles IS NULL THEN 0 WHEN miles <= 5 THEN 10 WHEN miles <= 15 THEN 5 ELSE 0 END FROM k)
      SELECT factor, status, count(*) AS n, sum(points)::BIGINT AS points FROM b GROUP BY 1, 2""",
    "distance_bands": f"WITH {PAIRS_SQL} SELECT sit_id, CASE WHEN miles <= 5 THEN 'near' WHEN miles <= 15 THEN 'mid' ELSE 'far' END AS band, count(*) AS n, round(max(miles), 6) AS most FROM p WHERE area1 NOT IN ('US', 'California') AND miles IS NOT NULL GROUP BY 1, 2",
    "income_brackets": f"WITH {PAIRS_SQL} SELECT sit_id, income AS status, count(*) AS n FROM p GROUP BY 1, 2",
    "docs_missing": f"""WITH {PAIRS_SQL}, m AS (SELECT sit_id, concat_ws(',', CASE WHEN lower(doc1) <> lower(doc_held) THEN doc1 END, CASE WHEN lower(doc2) <> lower(doc_held) THEN doc2 END) AS missing FROM p WHERE doc_held IS NOT NULL)
      SELECT sit_id, missing, count(*) AS n FROM m WHERE missing <> '' GROUP BY 1, 2""",
}

QUERIES = {f.__name__: f for f in (match_gates, match_excluded_counts, match_counts, match_scores, match_rank, match_related_topk, match_breakdown, distance_bands, income_brackets, docs_missing)}
