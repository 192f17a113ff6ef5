"""Registered queries on text: sentences are written from the derived situations and programmes, parsed, and held against the columns that they were written from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import relevance as R
from ..functions import rules
from ..functions import spanish as S
from ..functions import text as T
from ..sources.derived import CATALOGUE_SQL, SITUATIONS_SQL, catalogue, dealt, table

#: A text for each situation; what is null isn't said.
_SAY = """
  concat_ws(' ',
    CASE WHEN city IS NOT NULL THEN concat('I live in ', city, '.') WHEN county IS NOT NULL THEN concat('I am somewhere in ', county, '.') END,
    CASE WHEN household_size IS NOT NULL THEN concat('We are a family of ', CAST(household_size AS VARCHAR(9)), '.') END,
    CASE WHEN monthly_income = 0 THEN 'I have no income.' WHEN monthly_income IS NOT NULL THEN concat('I make $', CAST(monthly_income AS VARCHAR(12)), ' a month.') END,
    CASE WHEN monthly_housing_cost IS NOT NULL THEN concat('My rent is $', CAST(monthly_housing_cost AS VARCHAR(12)), ' a month.') END,
    CASE WHEN age IS NOT NULL THEN concat('I am ', CAST(age AS VARCHAR(4)), ' years old.') END,
    CASE housing_status WHEN 'housed_stable' THEN 'I am current on my rent.' WHEN 'housed_at_risk' THEN 'I am behind on rent, no eviction notice yet.' WHEN 'eviction_notice' THEN 'I got an eviction notice.' WHEN 'unhoused' THEN 'I am sleeping in my car.' END,
    CASE WHEN has_children THEN 'I have 2 kids.' WHEN NOT has_children THEN 'I have no kids.' END,
    CASE WHEN is_veteran THEN 'I am a veteran.' WHEN NOT is_veteran THEN 'I am not a veteran.' END,
    CASE sit_id % 5 WHEN 1 THEN 'I want to die.' WHEN 2 THEN 'I am not suicidal.' END)
"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT sit_id AS key, {_SAY} AS text FROM ({SITUATIONS_SQL.replace('FROM customer', 'FROM {customer}')}) s", customer=table(spark, sf_dir, "customer"))


def parse_situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.parse(texts(spark, sf_dir))
    return p.select("key", "household_size", "monthly_income", "monthly_housing_cost", "age", "housing_status", "has_children", "is_veteran", "crisis", "city", "county")


#: The same in Spanish, as far as there are words for it.
_DICE = """
  concat_ws(' ', 'Necesito ayuda con la comida.',
    CASE WHEN city IS NOT NULL THEN concat('Vivo en ', replace(city, 'San Jose', 'San José'), '.') END,
    CASE WHEN household_size IS NOT NULL THEN concat('Somos una familia de ', CAST(household_size AS VARCHAR(9)), '.') END,
    CASE WHEN monthly_income = 0 THEN 'No tengo ingresos.' WHEN monthly_income IS NOT NULL THEN concat('Gano $', CAST(monthly_income AS VARCHAR(12)), ' al mes.') END,
    CASE WHEN monthly_housing_cost IS NOT NULL THEN concat('La renta es $', CAST(monthly_housing_cost AS VARCHAR(12)), ' al mes.') END,
    CASE WHEN age IS NOT NULL THEN concat('Tengo ', CAST(age AS VARCHAR(4)), ' años.') END,
    CASE housing_status WHEN 'housed_at_risk' THEN 'Debo la renta.' WHEN 'eviction_notice' THEN 'Me dieron un aviso de desalojo.' WHEN 'unhoused' THEN 'Duermo en mi carro.' END,
    CASE WHEN has_children THEN 'Tengo dos hijos.' WHEN NOT has_children THEN 'No tengo hijos.' END,
    CASE WHEN is_veteran THEN 'Soy veterano.' WHEN NOT is_veteran THEN 'No soy veterano.' END)
"""


def _spanish_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT sit_id AS key, {_DICE} AS text FROM ({SITUATIONS_SQL.replace('FROM customer', 'FROM {customer}')}) s", customer=table(spark, sf_dir, "customer"))


def spanish_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish texts in English phrases; every other one is English, and stays."""
    both = _spanish_texts(spark, sf_dir).unionByName(texts(spark, sf_dir).withColumn("key", -F.col("key")))
    return dealt(both, "key").select("key", S.looks_spanish(F.col("text")).alias("spanish"), T.normalize(F.col("text")).alias("normal"))


def spanish_situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.parse(_spanish_texts(spark, sf_dir))
    return p.select("key", "household_size", "monthly_income", "monthly_housing_cost", "age", "housing_status", "has_children", "is_veteran", "city", "county")


def crisis_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).filter(T.crisis(F.col("text"))).select("key")


def zip_to_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A postcode for each customer, half of them only known by its first three digits."""
    c = table(spark, sf_dir, "customer")
    t = c.select(F.col("c_custkey").alias("key"), F.concat(F.lit("My zip is "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("951"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))).otherwise(F.element_at(F.array(*map(F.lit, ("94022", "94063", "95014", "94612", "96001"))), (F.col("c_custkey") % 5 + 1).cast("int"))), F.lit(", rent 9500 a month")).alias("text"))
    return T.resolve_places(t).select("key", "city", "county", "zip")


_PAGE = """
  concat_ws(' ', concat('About ', name, '.'),
    CASE WHEN max_ami_percent IS NOT NULL THEN concat('Open up to ', CAST(max_ami_percent AS VARCHAR(4)), '% of Area Median Income.') END,
    CASE WHEN max_fpl_percent IS NOT NULL THEN concat('Below ', CAST(max_fpl_percent AS VARCHAR(4)), ' percent of the federal poverty level.') END,
    CASE WHEN max_annual_income IS NOT NULL THEN 'Annual income of no more than $32,900 a year.' END,
    CASE WHEN requires_veteran THEN 'Applicants must be veterans.' END, CASE WHEN requires_children THEN 'For families with minor children.' END,
    CASE WHEN requires_eviction_notice THEN 'You must have received an eviction notice.' END,
    CASE status_any1 WHEN 'unhoused' THEN 'For people experiencing homelessness.' WHEN 'housed_at_risk' THEN 'For tenants behind on their rent.' END,
    CASE ord % 7 WHEN 0 THEN 'Serves zip codes: 95112, 95113 and 95112.' WHEN 1 THEN 'Be a resident of Kern County for at least 30 days.' WHEN 2 THEN 'For CalWORKs participants.' WHEN 3 THEN 'Low-income tenants first.' WHEN 4 THEN 'Up to 60% of state median income, child welfare.' END)
"""


def eligibility_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(f"SELECT id, {_PAGE} AS text FROM ({CATALOGUE_SQL.replace('FROM supplier', 'FROM {supplier}')}) c", supplier=table(spark, sf_dir, "supplier"))
    e = p.select("id", rules.eligibility(F.col("text")).alias("e")).select("id", "e.*")
    return e.withColumn("housing_status_any_of", F.array_join("housing_status_any_of", ","))


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programmes of each category, zero for those without one."""
    from ..sources.dimensions import CATEGORIES

    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    n = catalogue(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    return every.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


#: A page for each supplier's programme: a topic in the title or only in the text, help or none, some of them news or bids.
_PAGES = """
SELECT s_suppkey AS page_id, concat('https://x.example.org/', CASE s_suppkey % 7 WHEN 1 THEN 'news/' WHEN 2 THEN 'rfp/' ELSE 'p/' END, CAST(s_suppkey AS VARCHAR(20))) AS url,
  CASE s_suppkey % 5 WHEN 0 THEN 'Food pantry' WHEN 1 THEN 'Emergency shelter' WHEN 2 THEN 'About us' WHEN 3 THEN 'Legal aid' ELSE 'Diabetes' END AS title,
  CASE s_suppkey % 3 WHEN 0 THEN 'How to apply for it.' WHEN 1 THEN 'Open on Mondays.' ELSE 'A clinic near you, with housing support.' END AS text FROM supplier
"""


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(_PAGES.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    none = F.array().cast("array<struct<url:string,text:string,navigation:boolean>>")
    r = R.relevance(F.col("url"), F.col("title"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.col("text"), none)
    return p.select("page_id", r.alias("r"), R.category(F.col("url"), F.col("title"), F.col("text")).alias("category"))


def page_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevance(spark, sf_dir).select("page_id", "r.score", "r.relevant", F.array_join("r.topics", ",").alias("topics"))


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevance(spark, sf_dir).select(F.explode("r.topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def category_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevance(spark, sf_dir).select("page_id", "category")


_RELEVANT = f"""
p AS ({_PAGES}), q AS (SELECT page_id, page_id % 5 AS a, page_id % 3 AS b, page_id % 7 AS c FROM p),
r AS (
  SELECT page_id, a, b, c, concat_ws(',', CASE WHEN b = 2 THEN 'rental_assistance' END, CASE WHEN a = 1 THEN 'shelter' END, CASE WHEN a = 0 THEN 'food' END, CASE WHEN a = 3 THEN 'legal' END, CASE WHEN b = 2 THEN 'health_care' END, CASE WHEN a = 4 THEN 'diabetes' END) AS topics,
    CASE a WHEN 2 THEN 0 ELSE 4 END + CASE WHEN b = 2 THEN 2 ELSE 0 END + CASE b WHEN 1 THEN 0 ELSE 2 END + CASE WHEN a IN (0, 1, 3) THEN 4 ELSE 0 END - CASE WHEN c IN (1, 2) THEN 4 ELSE 0 END AS score,
    c NOT IN (1, 2) AND (a <> 2 OR b = 2) AND (b <> 1 OR a IN (0, 1, 3)) AS relevant FROM q)"""

ORACLES = {
    "page_relevance": f"WITH {_RELEVANT} SELECT page_id, score, relevant, topics FROM r",
    "topic_counts": f"WITH {_RELEVANT} SELECT topic, count(*) AS n FROM (SELECT unnest(string_split(topics, ',')) AS topic FROM r WHERE topics <> '') GROUP BY 1",
    "category_assign": f"WITH {_RELEVANT} SELECT page_id, CASE a WHEN 0 THEN 'food' WHEN 1 THEN 'shelter' WHEN 3 THEN 'legal' WHEN 4 THEN 'condition_support' ELSE CASE WHEN b = 2 THEN 'health' END END AS category FROM r",
    "parse_situations": f"""WITH s AS ({SITUATIONS_SQL}) SELECT sit_id AS key, coalesce(household_size, CASE WHEN has_children THEN 3 END)::INT AS household_size, monthly_income::DOUBLE AS monthly_income, monthly_housing_cost::DOUBLE AS monthly_housing_cost, age::INT AS age, housing_status, has_children, is_veteran,
      sit_id % 5 = 1 AS crisis, city, CASE WHEN city IS NOT NULL OR county <> 'Kern County' THEN county END AS county FROM s""",
    "spanish_normalize": f"""WITH s AS ({SITUATIONS_SQL})
      SELECT sit_id AS key, true AS spanish, concat_ws(' ', 'need help with la food.', CASE WHEN city IS NOT NULL THEN 'i live in ' || lower(city) || '.' END, CASE WHEN household_size IS NOT NULL THEN 'we are una family of ' || household_size || '.' END,
        CASE WHEN monthly_income = 0 THEN 'no income.' WHEN monthly_income IS NOT NULL THEN 'i make $' || monthly_income::VARCHAR || ' a month.' END, CASE WHEN monthly_housing_cost IS NOT NULL THEN 'la rent is $' || monthly_housing_cost::VARCHAR || ' a month.' END,
        CASE WHEN age IS NOT NULL THEN 'i am ' || age || '.' END, CASE housing_status WHEN 'housed_at_risk' THEN 'behind on rent.' WHEN 'eviction_notice' THEN 'me dieron un eviction notice.' WHEN 'unhoused' THEN 'sleeping in my car.' END,
        CASE WHEN has_children THEN 'i have two kids.' WHEN NOT has_children THEN 'no kids.' END, CASE WHEN is_veteran THEN 'i''m veteran.' WHEN NOT is_veteran THEN 'not a veteran.' END) AS normal FROM s
      UNION ALL SELECT -sit_id, false, trim({_SAY}) FROM s""",
    "spanish_situations": f"""WITH s AS ({SITUATIONS_SQL}) SELECT sit_id AS key, coalesce(household_size, CASE WHEN has_children THEN 3 END)::INT AS household_size, monthly_income::DOUBLE AS monthly_income, monthly_housing_cost::DOUBLE AS monthly_housing_cost, age::INT AS age,
      nullif(housing_status, 'housed_stable') AS housing_status, has_children, is_veteran, city, CASE WHEN city IS NOT NULL THEN county END AS county FROM s""",
    "crisis_screen": "SELECT c_custkey AS key FROM customer WHERE c_custkey % 5 = 1",
    "zip_to_place": """SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'San Jose' ELSE ['Los Altos', 'Redwood City', 'Cupertino', 'Oakland', NULL][c_custkey % 5 + 1] END AS city,
      CASE WHEN c_custkey % 2 = 0 THEN 'Santa Clara County' ELSE ['Santa Clara County', 'San Mateo County', 'Santa Clara County', 'Alameda County', NULL][c_custkey % 5 + 1] END AS county,
      CASE WHEN c_custkey % 2 = 0 THEN '951' || lpad((c_custkey % 100)::VARCHAR, 2, '0') ELSE ['94022', '94063', '95014', '94612', NULL][c_custkey % 5 + 1] END AS zip FROM customer""",
    "eligibility_extract": f"""WITH c AS ({CATALOGUE_SQL}) SELECT id, max_annual_income::DOUBLE AS max_annual_income, max_ami_percent::DOUBLE AS max_ami_percent, max_fpl_percent::DOUBLE AS max_fpl_percent, requires_veteran, requires_children, CASE WHEN requires_eviction_notice THEN true END AS requires_eviction_notice,
      CASE status_any1 WHEN 'unhoused' THEN 'unhoused' WHEN 'housed_at_risk' THEN 'housed_at_risk,eviction_notice' END AS housing_status_any_of,
      CASE ord % 7 WHEN 0 THEN 'Serves ZIP codes 95112, 95113.' WHEN 1 THEN 'Must be a resident of Kern County for at least 30 days.' WHEN 2 THEN 'Must be receiving (or applying for) CalWORKs.'
        WHEN 3 THEN CASE WHEN coalesce(max_annual_income, max_ami_percent, max_fpl_percent) IS NULL THEN 'Income limits apply; the amounts are not published on the page.' END
        WHEN 4 THEN 'Income limit 60% of state median income. Family must be involved with the child welfare system.' END AS notes FROM c""",
    "candidate_counts": f"WITH c AS ({CATALOGUE_SQL}), k AS (SELECT unnest(range(15)) AS no), x AS (SELECT no, count(id) AS n FROM k LEFT JOIN c ON category_no = no GROUP BY 1) SELECT (['rental_assistance', 'food', 'utility', 'shelter', 'employment', 'legal', 'health', 'benefits', 'family_support', 'veteran_support', 'older_adult_support', 'disability', 'mental_health', 'substance_use', 'condition_support'])[no + 1] AS category, n FROM x",
}

QUERIES = {f.__name__: f for f in (parse_situations, spanish_normalize, spanish_situations, crisis_screen, zip_to_place, eligibility_extract, candidate_counts, page_relevance, topic_counts, category_assign)}
