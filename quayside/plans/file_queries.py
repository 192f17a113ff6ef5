"""Registered queries on files as they come in (snapshots, candidates, overrides, a catalogue before) and on the owners of links, with their DuckDB equivalents.

The files are written from the given tables to the shared folder, with a record on each line, and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import catalogue as L
from ..operators import mapdata as D
from ..operators.dedup import shared_folder
from ..sources.derived import table

_PAGES = "sources array<struct<id: string, pages: array<struct<page_id: bigint, url: string>>>>"
#: Pages of a part of a source, and overrides on a line: lists that are gathered have no more entries.
PART = 200


def snapshot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages as a snapshot by sources, whose pages lie in parts of bounded length, flattened again in order."""
    folder = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("s"), (k % 3).cast("string")).alias("id"), F.floor(k / PART).alias("part"), k, "url")
    pages = F.array_sort(F.collect_list(F.struct("page_id", "url")))
    p.groupBy("id", "part").agg(pages.alias("pages")).select(F.array(F.struct("id", "pages")).alias("sources")).write.json(folder)
    flat = L.flatten_snapshot(L.read_existing(spark, [f"{folder}-absent", folder], _PAGES, lines=True))
    return flat.select("source_id", "source_ord", "page_ord", "page_id", "url")


def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two files of three, the third absent; overrides by id; and which of them a catalogue before had, of which one exists and one doesn't."""
    folder = f"{shared_folder(spark)}/candidates-{uuid.uuid4().hex}"
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, F.concat(F.lit("c"), k.cast("string")).alias("id"), F.col("c_name").alias("name"))
    c.filter(k % 2 == 0).select("id", "name").write.json(f"{folder}/a")
    c.filter(k % 3 == 0).select("id", "name").write.json(f"{folder}/b")
    over = F.struct((k % 4 == 0).alias("exclude"), F.when(k % 5 == 0, False).alias("active"))
    entries = c.filter(k % 6 == 0).groupBy(F.floor(k / PART)).agg(F.map_from_entries(F.collect_list(F.struct("id", over))).alias("overrides"))
    entries.select("overrides").write.json(f"{folder}/o")
    found = L.read_existing(spark, [f"{folder}/{x}" for x in ("absent", "a", "b")], "id string, name string", lines=True)
    overrides = L.read_overrides(spark, f"{folder}/o", "exclude: boolean, active: boolean", lines=True)
    before = L.read_previous(spark, f"{folder}/b", "id string", lines=True).unionByName(L.read_previous(spark, f"{folder}/absent", "id string", lines=True))
    rows = found.groupBy("id").agg(F.min("file_ord").alias("first_file"), F.count("*").alias("files"), F.min_by("name", "file_ord").alias("name"))
    return rows.join(overrides, "id", "left").join(before.withColumn("before", F.lit(True)), "id", "left").select("id", "name", "first_file", "files", "exclude", "active", F.coalesce("before", F.lit(False)).alias("before"))


#: A link for each order, found by one of the sources, and a source for each nation: several share an origin, some own only a folder of it.
_LINKS = """
SELECT o_orderkey AS k, concat('https://host', CAST(o_orderkey % 9 AS VARCHAR(9)), '.example.org/', CASE o_orderkey % 4 WHEN 0 THEN 'p/' WHEN 1 THEN 'P/' WHEN 2 THEN 'q/' ELSE 'pq/' END, CAST(o_custkey % 50 AS VARCHAR(20))) AS url,
  CASE WHEN o_orderkey % 11 <> 0 THEN concat('s', CAST(o_custkey % 30 AS VARCHAR(9))) END AS found_by
FROM orders
"""
_SOURCES = """
SELECT concat('s', CAST(n_nationkey AS VARCHAR(9))) AS source_id, CAST(24 - n_nationkey AS INT) AS ord, concat('https://host', CAST(n_nationkey % 7 AS VARCHAR(9)), '.example.org') AS origin, CASE n_nationkey % 4 WHEN 0 THEN '/p' WHEN 1 THEN '/q/' WHEN 2 THEN '/p' ELSE '/' END AS prefix
FROM nation
"""


def link_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of links by a registry of sources that is read from a file."""
    folder = f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"
    links = spark.sql(_LINKS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    sources = spark.sql(_SOURCES.replace("FROM nation", "FROM {nation}"), nation=table(spark, sf_dir, "nation"))
    prefixes = F.when(F.col("prefix") != "/", F.array("prefix"))
    sources.select(F.col("source_id").alias("id"), F.col("ord").alias("crawlOrder"), F.array("origin").alias("allowedOrigins"), prefixes.alias("allowedPathPrefixes")).write.json(folder)
    return C.owners(links, L.read_sources(spark, [folder], lines=True)).select("k", "url", "found_by", "owner")


#: Outlines of a square for each supplier; those of a nation are the polygons of one shape, or one polygon where it has one supplier.
_SQUARES = """
SELECT concat('n', CAST(s_nationkey AS VARCHAR(9))) AS name, s_suppkey AS k, s_suppkey % 17 AS x, s_suppkey % 13 AS y, 1 + s_suppkey % 5 AS w, 1 + s_suppkey % 3 AS h FROM supplier
"""


def outline_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of shapes that are written as GeoJSON, a shape of at most as many polygons as a part on a line, and read back."""
    folder = f"{shared_folder(spark)}/outlines-{uuid.uuid4().hex}"
    s = spark.sql(_SQUARES.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    at = lambda x, y: F.array((F.col("x") + x).cast("double"), (F.col("y") + y).cast("double"))
    ring = F.array(at(0, 0), at(F.col("w"), 0), at(F.col("w"), F.col("h")), at(0, F.col("h")), at(0, 0))
    shapes = s.groupBy("name", F.floor(F.col("k") / PART).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.array(ring).alias("p")))), lambda z: z["p"]).alias("polygons"))
    shapes = shapes.withColumn("name", F.concat("name", F.lit("/"), F.col("part").cast("string")))
    single = F.size("polygons") == 1
    text = F.when(single, F.to_json(F.col("polygons")[0])).otherwise(F.to_json("polygons"))
    geometry = F.concat(F.lit('{"type": "'), F.when(single, "Polygon").otherwise("MultiPolygon"), F.lit('", "coordinates": '), text, F.lit("}"))
    line = F.concat(F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "'), F.col("name"), F.lit('"}, "geometry": '), geometry, F.lit("}]}"))
    shapes.select(line.alias("value")).write.text(folder)
    return D.centroids(D.read_outlines(spark, folder, lines=True)).select("name", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


ORACLES = {
    "outline_centres": f"""SELECT name || '/' || (k // {PART}) AS name, round(arg_max(y + h / 2, (w * h, -k)), 6) AS lat, round(arg_max(x + w / 2, (w * h, -k)), 6) AS lng FROM ({_SQUARES}) GROUP BY name, k // {PART}""",
    "snapshot_pages": f"SELECT 's' || (page_id % 3) AS source_id, 0::INT AS source_ord, (row_number() OVER (PARTITION BY page_id % 3, page_id // {PART} ORDER BY page_id, url) - 1)::INT AS page_ord, page_id, url FROM pages",
    "candidate_files": """SELECT 'c' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END::INT AS first_file, ((c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT)::BIGINT AS files,
      CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 4 = 0 END AS exclude, CASE WHEN c_custkey % 30 = 0 THEN false END AS active, c_custkey % 3 = 0 AS before FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""",
    "link_owners": f"""WITH l AS ({_LINKS}), s AS ({_SOURCES}), j AS (
      SELECT k, source_id, row_number() OVER (PARTITION BY k ORDER BY source_id IS DISTINCT FROM found_by, ord) AS r FROM l JOIN s ON starts_with(url, origin || '/') AND (prefix = '/' OR starts_with(lower(url), origin || rtrim(prefix, '/') || '/')))
      SELECT l.k, url, found_by, source_id AS owner FROM l LEFT JOIN j ON j.k = l.k AND r = 1""",
}

QUERIES = {f.__name__: f for f in (snapshot_pages, candidate_files, link_owners, outline_centres)}
