"""Registered queries on the loaded catalogue, on leads and on texts of plans, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import catalogue as L
from ..operators import mapdata as D
from ..sources.derived import CATALOGUE_SQL, catalogue, table
from ..sources.dimensions import CATEGORIES


def catalogue_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.checked(catalogue(spark, sf_dir)).withColumn("at", L.area_coordinates(F.col("service_area")))
    return c.select("id", "category", "at.lat", "at.lng")


def eligibility_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some have rules, some a review, and some state rules only in their excerpt."""
    c = catalogue(spark, sf_dir)
    rules = F.struct(F.when(F.col("ord") % 3 == 0, 50.0).alias("max_ami_percent"), F.lit(None).cast("boolean").alias("requires_veteran"))
    excerpt = F.when(F.col("ord") % 2 == 0, "Applicants must be veterans.").otherwise("Come as you are.")
    d = c.select("id", "ord", "name", F.lit("About it.").alias("description"), excerpt.alias("excerpt"), rules.alias("eligibility"), (F.col("ord") % 5 == 0).alias("overridden"))
    return L.backfill(d).select("id", "eligibility.*", "backfilled")


#: A link for each order: some to documents, some to sources that nobody owns, some too deep, some in menus, some traps.
_LINKS = """
SELECT o_orderkey AS k, concat('https://Host', CAST(o_orderkey % 7 AS VARCHAR(9)), '.example.org/', CASE o_orderkey % 11 WHEN 0 THEN 'search/' WHEN 1 THEN 'share/' ELSE 'p/' END, CAST(o_custkey % 50 AS VARCHAR(20)), CASE o_orderkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '' END, '?utm_source=x') AS url,
  concat('page', CAST(o_custkey % 20 AS VARCHAR(20))) AS found_from, concat('link ', CAST(o_orderkey AS VARCHAR(20))) AS text, o_orderkey % 9 = 4 AS navigation, CASE WHEN o_orderkey % 7 < 4 THEN 's' END AS owner, CAST(o_orderkey % 8 AS INT) AS depth
FROM orders
"""


def retained_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spark.sql(_LINKS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    # one reason for each url of a page, as the order of links within a page isn't part of the table
    return L.leads(links.withColumn("text", F.lit("link")), 4).select("url", "found_from", "reason", "kind")


def needs_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs as picked and as read, with unknown ones and repetitions among them; and signs of crisis stored before and found now."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sit_id"))
    k, names = F.col("sit_id"), F.array(*map(F.lit, CATEGORIES))
    at = lambda n: F.element_at(names, (n % 15 + 1).cast("int"))
    picked = F.when(k % 3 == 0, F.array(at(k), F.lit("yachts"), at(k + 1), at(k))).when(k % 3 == 1, F.array(F.lit("yachts")))
    read = F.when(k % 4 != 0, F.array(at(k + 1), at(k + 2)))
    found = F.when(k % 5 == 0, F.array(F.lit("suicidal"))).otherwise(F.array().cast("array<string>"))
    stored = F.when(k % 2 == 0, F.array(F.lit("danger"), F.lit("suicidal")))
    label = L.place_label(F.when(k % 4 == 0, "San Jose"), F.when(k % 3 == 0, "Kern County"), F.when(k % 2 == 0, "95112"))
    return c.select("sit_id", F.array_join(L.picked_needs(picked, read), ",").alias("needs"), F.array_join(L.indicators(stored, found), ",").alias("indicators"), label.alias("label"))


_WORDS = {"title": "Your plan", "benefits": "Likely:", "steps": "Steps:", "docs": "Bring:", "footer": "Call first.", "now": "Now", "today": "Today", "week": "This week", "next": "Next"}


def share_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sit_id"), "c_name")
    k = F.col("sit_id")
    step = lambda when, text, phone: F.struct(F.lit(when).alias("when"), text.alias("text"), phone.alias("phone"))
    steps = F.array(step("today", F.lit("Call the office"), F.when(k % 2 == 0, F.col("c_name"))), step("next", F.concat(F.lit("Keep folder "), k.cast("string")), F.lit("")))
    likely = F.when(k % 3 == 0, F.array(F.struct(F.lit("Food").alias("title"), F.concat(F.lit("$"), k.cast("string")).alias("value"))))
    docs = F.when(k % 4 == 0, F.array(F.lit("ID"), F.lit("Lease"))).otherwise(F.array().cast("array<string>"))
    return c.select("sit_id", L.share_text(likely, steps, docs, _WORDS).alias("text"))


def placement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dot for each order of a customer, and programmes of the state and the country for each customer."""
    kind = F.element_at(F.array(F.lit("address"), F.lit("county"), F.lit("near_you")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    dots = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sit_id"), kind.alias("placement"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sit_id"), F.explode(F.create_map(F.lit("*statewide"), F.col("c_nationkey") + 100, F.lit("*national"), F.col("c_custkey") % 9, F.lit("Kern"), F.lit(7))).alias("place", "n"))
    return L.placement_counts(dots, c.withColumn("n", F.col("n").cast("long")))


#: For each supplier an outline of five points, closed, on whole numbers; those of a nation share a name.
_RINGS = """
SELECT CAST(s_nationkey AS VARCHAR(9)) AS name, CAST(s_suppkey AS INT) AS ring, CAST(p.k AS INT) AS seq,
  CAST(s_suppkey % 17 + CASE WHEN p.k IN (1, 2) THEN 2 * (1 + s_suppkey % 5) ELSE 0 END AS DOUBLE) AS lng,
  CAST(s_suppkey % 13 + CASE p.k WHEN 2 THEN 4 * (1 + s_suppkey % 3) WHEN 3 THEN 2 * (1 + s_suppkey % 3) ELSE 0 END AS DOUBLE) AS lat
FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS p(k)
"""


def county_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = spark.sql(_RINGS.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    return D.centroids(rings).select("name", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_ABOUT = "Helps households in the district with number {} to pay for heating, water and repairs all year round"


def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a page for each customer: endings of titles that don't count, descriptions that say little, pages without evidence."""
    k = F.col("c_custkey")
    number = (k % 40).cast("string")
    title = F.concat(F.lit("Energy Help "), number, F.when(k % 3 == 0, " - Consumer").when(k % 3 == 1, " | State pages").otherwise(""))
    about = F.concat(F.lit(_ABOUT.split("{}")[0]), number, F.lit(_ABOUT.split("{}")[1]))
    description, excerpt = F.when(k % 4 < 2, about).when(k % 4 == 2, F.lit("Welcome.")), F.when(k % 5 != 0, about)
    key = C.page_identity(title, description, excerpt)
    return table(spark, sf_dir, "customer").select("c_custkey", F.replace(key, F.lit("\u001f"), F.lit("#")).alias("key"))


_CAT = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
ORACLES = {
    "placement_counts": """WITH d AS (SELECT o_custkey AS sit_id, count_if(o_orderkey % 3 = 0) AS exact, count(*) AS dots, count_if(o_orderkey % 3 = 2) AS near FROM orders GROUP BY 1)
      SELECT c_custkey AS sit_id, coalesce(exact, 0)::BIGINT AS exact, (coalesce(dots, 0) - coalesce(exact, 0))::BIGINT AS approximate, (c_nationkey + 100 + c_custkey % 9 - coalesce(near, 0))::BIGINT AS not_drawn FROM customer LEFT JOIN d ON sit_id = c_custkey""",
    "county_centroids": f"""WITH e AS (SELECT *, lead(lng) OVER w AS x1, lead(lat) OVER w AS y1 FROM ({_RINGS}) WINDOW w AS (PARTITION BY ring ORDER BY seq)), f AS (SELECT *, lng * y1 - x1 * lat AS z FROM e WHERE x1 IS NOT NULL),
      a AS (SELECT name, ring, sum(z) / 2 AS area, sum((lng + x1) * z) AS cx, sum((lat + y1) * z) AS cy FROM f GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY abs(area) DESC, ring) AS r FROM a)
      SELECT name, round(cy / (6 * area), 6) AS lat, round(cx / (6 * area), 6) AS lng FROM b WHERE r = 1""",
    "page_identity": f"""SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 OR c_custkey % 5 <> 0 THEN lower(concat('energy help ', c_custkey % 40, '#', replace(replace('{_ABOUT}', ',', ''), '{{}}', (c_custkey % 40)::VARCHAR))) END AS key FROM customer""",
    "catalogue_coordinates": f"""WITH c AS ({CATALOGUE_SQL}), a AS (SELECT id, {_CAT}[category_no + 1] AS category, list_filter(list_transform([area1, area2], lambda x: CASE WHEN x LIKE 'Santa Clara%' THEN 'Santa Clara' WHEN x LIKE 'San Mateo%' THEN 'San Mateo' WHEN x LIKE 'Alameda%' THEN 'Alameda' WHEN x LIKE '%, CA' THEN split_part(x, ',', 1) END), lambda x: x IS NOT NULL)[1] AS place FROM c)
      SELECT id, category, CASE place WHEN 'Santa Clara' THEN 37.3382e0 WHEN 'San Jose' THEN 37.3382e0 WHEN 'San Mateo' THEN 37.4688e0 WHEN 'Redwood City' THEN 37.4852e0 WHEN 'Alameda' THEN 37.8044e0 WHEN 'Oakland' THEN 37.8044e0 END AS lat,
        CASE place WHEN 'Santa Clara' THEN -121.8863e0 WHEN 'San Jose' THEN -121.8863e0 WHEN 'San Mateo' THEN -122.1411e0 WHEN 'Redwood City' THEN -122.2364e0 WHEN 'Alameda' THEN -122.2712e0 WHEN 'Oakland' THEN -122.2712e0 END AS lng FROM a""",
    "eligibility_backfill": f"WITH c AS ({CATALOGUE_SQL}) SELECT id, CASE WHEN ord % 3 = 0 THEN 50.0::DOUBLE END AS max_ami_percent, CASE WHEN ord % 3 <> 0 AND ord % 5 <> 0 AND ord % 2 = 0 THEN true END AS requires_veteran, ord % 3 <> 0 AND ord % 5 <> 0 AND ord % 2 = 0 AS backfilled FROM c",
    "retained_leads": f"""WITH l AS (SELECT *, regexp_replace(replace(url, 'https://Host', 'https://host'), '[?].*$', '') AS u FROM ({_LINKS})),
      r AS (SELECT u AS url, found_from, CASE WHEN k % 6 = 0 THEN 'document' ELSE 'page' END AS kind, CASE WHEN k % 6 = 0 OR owner IS NULL THEN CASE WHEN NOT navigation AND k % 11 <> 1 THEN CASE WHEN k % 6 = 0 THEN 'document_needs_extraction' ELSE 'outside_configured_sources' END END WHEN depth > 4 AND NOT navigation THEN 'depth_limit' END AS reason FROM l WHERE k % 11 <> 0 AND k % 6 <> 1)
      SELECT url, found_from, min(reason) AS reason, min(kind) AS kind FROM r WHERE reason IS NOT NULL GROUP BY 1, 2""",
    "needs_merged": f"""WITH n AS (SELECT c_custkey AS k, {_CAT} AS a FROM customer), x AS (SELECT k, a[k % 15 + 1] AS n0, a[(k + 1) % 15 + 1] AS n1, a[(k + 2) % 15 + 1] AS n2 FROM n)
      SELECT k AS sit_id, CASE WHEN k % 3 = 0 THEN n0 || ',' || n1 || CASE WHEN k % 4 <> 0 THEN ',' || n2 ELSE '' END WHEN k % 4 <> 0 THEN n1 || ',' || n2 END AS needs,
        CASE WHEN k % 2 = 0 THEN 'danger,suicidal' WHEN k % 5 = 0 THEN 'suicidal' END AS indicators, CASE WHEN k % 4 = 0 THEN 'San Jose' WHEN k % 3 = 0 THEN 'Kern County' WHEN k % 2 = 0 THEN 'ZIP 95112' ELSE 'Your location' END AS label FROM x""",
    "share_texts": """SELECT c_custkey AS sit_id, array_to_string(list_concat(['Your plan', ''], CASE WHEN c_custkey % 3 = 0 THEN ['Likely:', '• Food: $' || c_custkey, ''] ELSE [] END, ['Steps:', '1. [Today] Call the office' || CASE WHEN c_custkey % 2 = 0 THEN ' (' || c_name || ')' ELSE '' END, '2. [Next] Keep folder ' || c_custkey],
      CASE WHEN c_custkey % 4 = 0 THEN ['', 'Bring:', '☐ ID', '☐ Lease'] ELSE [] END, ['', 'Call first.']), chr(10)) AS text FROM customer""",
}

QUERIES = {f.__name__: f for f in (catalogue_coordinates, eligibility_backfill, retained_leads, needs_merged, share_texts, placement_counts, county_centroids, page_identity)}
