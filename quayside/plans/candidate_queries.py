"""Registered queries on candidates: pages are written from the suppliers with planted names, keys and links, turned into candidates, and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..sources.derived import table

#: A page for each supplier: what is planted depends on remainders of its key alone.
_PAGES = """
SELECT s_suppkey AS ord, concat('s', CAST(s_suppkey % 3 AS VARCHAR(2))) AS source_id,
  concat(CASE s_suppkey % 5 WHEN 0 THEN 'https://www.ftb.ca.gov/caleitc/' WHEN 1 THEN 'https://x.ca.gov/p/' ELSE 'https://a.example.org/p/' END, CAST(s_suppkey AS VARCHAR(20))) AS url,
  CASE WHEN s_suppkey % 17 = 3 THEN 'Contact us' ELSE concat('Harbor ', CASE WHEN s_suppkey % 2 = 0 THEN 'food bank program ' ELSE 'Food Bank ' END, CAST(s_suppkey % 23 AS VARCHAR(4)), ' | Hall') END AS title,
  concat('Groceries of kind ', CAST(s_suppkey % 7 AS VARCHAR(2)), ' for all who ask for them, every week at the hall near the station, from nine to noon.') AS long,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Applicants must be veterans.' ELSE 'Come as you are.' END AS more,
  CASE s_suppkey % 6 WHEN 0 THEN 'challenge' WHEN 1 THEN 'shell' ELSE 'page' END AS state
FROM supplier
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(_PAGES.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    c, none = F.col, F.lit(None).cast("string")
    link = lambda url, text, nav, related=False: F.struct(F.concat(F.lit(url), (c("ord") % 4).cast("string")).alias("url"), F.lit(text).alias("text"), F.lit(nav).alias("navigation"), F.lit("near").alias("context"), F.lit(related).alias("related"))
    links = F.array(link("https://m/", "Apply for food", True), link("https://c/", "Contact us", False), link("https://f/", "Food: apply", False))
    return p.withColumns({
        "canonical": none, "headings": F.array(F.lit("Menu"), F.lit("Hours")), "description": none, "excerpt": c("long"), "text": F.concat_ws(" ", "long", "more"), "links": F.when(c("ord") % 3 == 0, F.slice(links, 1, 2)).otherwise(links),
        "phones": F.array(F.lit("4085550100")), "emails": F.array().cast("array<string>"),
    })


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([(f"s{k}", f"Hall {k}", "California", k == 2, k == 1, {}) for k in range(3)], "source_id string, name string, service_area string, organization_from_title boolean, skip_eligibility boolean, category_by_path map<string,string>")
    return C.make_candidates(_pages(spark, sf_dir), sources)


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("ord", "id", "name", "organization", "category", "description", "application_url", F.coalesce("eligibility.requires_veteran", F.lit(False)).alias("veterans"), F.size("linked").alias("n_linked"))


def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, _ = C.merge_candidates(_candidates(spark, sf_dir))
    return merged.select("group", "ord", "n_merged", "source_url")


def candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links = C.merge_candidates(_candidates(spark, sf_dir))
    return links.select("group", F.col("place.ord").alias("first_ord"), "url", "text")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages end in which way."""
    p = _pages(spark, sf_dir)
    html = F.when(F.col("state") == "challenge", "<title>Just a moment...</title>").when(F.col("state") == "shell", "You need to enable JavaScript").otherwise("<p>")
    text = F.when(F.col("state") == "page", F.repeat("text", 2)).otherwise("")
    return p.select(C.page_outcome(html, text, F.col("ord") % 5 != 4).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


_MADE = f"""
p AS (SELECT *, CASE WHEN ord % 5 = 0 THEN 'California Earned Income Tax Credit' ELSE regexp_replace(title, ' [|] Hall$', '') END AS name FROM ({_PAGES})),
c AS (
  SELECT ord, name, CASE source_id WHEN 's2' THEN name ELSE 'Hall ' || source_id[2:] END AS organization, long || ' ' || more AS description, url, CASE WHEN ord % 5 = 0 THEN 'benefits' ELSE 'food' END AS category,
    source_id <> 's1' AND ord % 4 = 0 AS e, ord % 5 = 0 AS p, ord % 5 < 2 AS g, CASE WHEN ord % 5 = 0 THEN -1 ELSE ord % 23 END AS nk, (ord % 7) || more AS dk FROM p WHERE ord % 17 <> 3 OR ord % 5 = 0)"""

#: Each candidate's parent is the latest one before it with its strongest key that any had; groups are roots.
_GROUPS = f"""{_MADE},
par AS (SELECT c.ord, coalesce(
    (SELECT max(b.ord) FROM c b WHERE b.ord < c.ord AND b.nk = c.nk AND b.category = c.category AND lower(b.organization) = lower(c.organization)),
    (SELECT max(b.ord) FROM c b WHERE b.ord < c.ord AND b.dk = c.dk AND b.category = c.category AND lower(b.organization) = lower(c.organization)),
    (SELECT max(b.ord) FROM c b WHERE b.ord < c.ord AND b.nk = c.nk AND b.category = c.category)) AS parent FROM c),
tree AS (SELECT ord, ord AS root FROM par WHERE parent IS NULL UNION ALL SELECT par.ord, tree.root FROM par JOIN tree ON par.parent = tree.ord),
f AS (SELECT c.*, root, bool_or(e) OVER (PARTITION BY root) AS some_e FROM c JOIN tree USING (ord))"""

ORACLES = {
    "page_candidates": f"""WITH {_MADE} SELECT ord, lower(replace(name, ' ', '-')) || '-' || sha256(url)[1:10] AS id, name, organization, category, description, CASE WHEN ord % 3 = 0 THEN 'https://c/' WHEN ord % 17 = 3 THEN 'https://c/' ELSE 'https://f/' END || (ord % 4) AS application_url, e AS veterans, CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END AS n_linked FROM c""",
    "candidate_merge": f"""WITH RECURSIVE {_GROUPS}, w AS (SELECT root, coalesce(max(ord) FILTER (p AND (e OR NOT some_e)), min(ord) FILTER (g AND (e OR NOT some_e)), min(ord) FILTER (e OR NOT some_e)) AS ord, count(*) AS n_merged FROM f GROUP BY 1)
      SELECT root AS "group", w.ord, n_merged, url AS source_url FROM w JOIN c ON c.ord = w.ord""",
    "candidate_links": f"""WITH RECURSIVE {_GROUPS} SELECT root AS "group", min(ord) AS first_ord, 'https://f/' || (ord % 4) AS url, 'Food: apply' AS text FROM f WHERE ord % 3 <> 0 GROUP BY root, ord % 4""",
    "page_outcomes": f"""SELECT CASE state WHEN 'challenge' THEN 'challenge' WHEN 'shell' THEN 'script_shell' ELSE CASE WHEN ord % 5 = 4 THEN 'irrelevant' ELSE 'candidate' END END AS outcome, count(*) AS n FROM ({_PAGES}) GROUP BY 1""",
}

QUERIES = {f.__name__: f for f in (page_candidates, candidate_merge, candidate_links, page_outcomes)}
