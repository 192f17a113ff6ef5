"""Loading a checked catalogue, its coordinates and missing rules, leads for later, and what the pages of a plan show as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.rules import eligibility, evidence
from ..functions.text import let
from ..functions.urls import crawl_trap, document_kind, normalize_url, useful_lead
from ..sources.dimensions import CATEGORIES, PLACES

# The version and the most bytes of a stored page.
PAGE_VERSION, PAGE_BYTES = 1, 2 * 1024 * 1024


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, in any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: p.getFileSystem(conf).exists(p)
    return [p for p in paths if there(jvm.org.apache.hadoop.fs.Path(p))]


def read_existing(spark: SparkSession, paths: list[str], schema: StructType | str, lines: bool = False) -> DataFrame:
    """The JSON records of those paths that exist, with `file_ord`, their path's place in the list; ValueError if none exists.

    A file that is one JSON value, such as a list of records, is read by one task. With `lines`, each line is a record, and
    files are split; a path may then be a folder of files too.
    """
    some = set(existing(spark, paths))
    found = [(k, p) for k, p in enumerate(paths) if p in some]
    if not found:
        raise ValueError(f"none of these exists: {', '.join(paths)}")
    out = None
    for k, p in found:
        part = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not lines).json(p).withColumn("file_ord", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def read_previous(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """The previous catalogue, or a table without rows if there is none."""
    try:
        return read_existing(spark, [path], schema, lines).drop("file_ord")
    except ValueError:
        return spark.createDataFrame([], schema)


def read_overrides(spark: SparkSession, path: str, fields: str, lines: bool = False) -> DataFrame:
    """(id, ...) of a JSON object of reviewed overrides by id; with `lines`, of such an object on each line."""
    whole = spark.read.schema(f"overrides map<string, struct<{fields}>>").option("mode", "FAILFAST").option("multiLine", not lines).json(path)
    return whole.select(F.explode("overrides").alias("id", "o")).select("id", "o.*")


def flatten_snapshot(snapshot: DataFrame) -> DataFrame:
    """(source_ord, page_ord, source_id, ...) of snapshot(sources array<struct<id, pages array<struct<...>>>>): a row for each page in order; sources without pages give none."""
    s = snapshot.select(F.posexplode("sources").alias("source_ord", "s"))
    return s.select("source_ord", F.col("s.id").alias("source_id"), F.posexplode("s.pages").alias("page_ord", "p")).select("source_ord", "page_ord", "source_id", "p.*")


#: Fields of a source of pages.
SOURCE = "id string, name string, startUrl string, startUrls array<string>, allowedOrigins array<string>, allowedPathPrefixes array<string>, serviceArea string, crawlOrder int, priority int, maxPages int"
PAGES_OF_SOURCE = 20


def read_sources(spark: SparkSession, paths: list[str], lines: bool = False) -> DataFrame:
    """(source_id, ord, name, seeds, origins, prefixes, service_area, priority, max_pages) of registries of sources, for owners(), with_definitions() and the ranking of links.

    ord counts the sources by crawl order, then by file and id, as sources are few. Seeds are the first url and the others,
    each once. A source without an id or an origin, and an id that comes twice, fail when they are read.
    """
    c = F.col
    s = read_existing(spark, paths, SOURCE, lines)
    w = Window.orderBy(F.coalesce("crawlOrder", F.lit(1 << 30)), "file_ord", "id")  # a registry holds some dozens of sources
    fail = lambda what: F.raise_error(F.concat(F.lit(what), F.coalesce(c("id"), F.lit("?"))))
    key = F.when(F.coalesce(c("id"), F.lit("")) == "", fail("source without an id: ")).when(F.coalesce(F.size("allowedOrigins"), F.lit(0)) < 1, fail("no origin of source ")).when(F.count("*").over(Window.partitionBy("id")) > 1, fail("source comes twice: ")).otherwise(c("id"))
    seeds = F.array_distinct(F.array_compact(F.concat(F.array("startUrl"), F.coalesce("startUrls", F.array().cast("array<string>")))))
    prefixes = F.when(F.size("allowedPathPrefixes") > 0, c("allowedPathPrefixes")).otherwise(F.array(F.lit("/")))
    return s.select(key.alias("source_id"), (F.row_number().over(w) - 1).alias("ord"), "name", seeds.alias("seeds"), c("allowedOrigins").alias("origins"), prefixes.alias("prefixes"), c("serviceArea").alias("service_area"), F.coalesce("priority", F.lit(0)).alias("priority"), F.coalesce("maxPages", F.lit(PAGES_OF_SOURCE)).alias("max_pages"))


def checked(catalogue: DataFrame) -> DataFrame:
    """The catalogue; reading a row of an unknown category fails, and so does an empty catalogue, at once."""
    if not catalogue.limit(1).count():
        raise ValueError("the catalogue is empty")
    known = F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False))
    return catalogue.withColumn("category", F.when(known, F.col("category")).otherwise(F.raise_error(F.concat(F.lit("unknown category of "), F.coalesce(F.col("id").cast("string"), F.lit("?"))))))


def valid_entries(stored: DataFrame) -> DataFrame:
    """Of stored(key, version, url, final_url, html, ...) what may be used again: of the present version, under the key of its own url, with a final url and html that isn't too large in UTF-8. Null html or final url is no entry; empty html is one."""
    own = (F.col("version") == PAGE_VERSION) & (F.col("key") == F.sha2("url", 256))
    return stored.filter(own & (F.coalesce("final_url", F.lit("")) != "") & (F.octet_length("html") <= PAGE_BYTES))


def area_coordinates(areas: Column) -> Column:
    """struct(lat, lng) of the first service area with a known place: the city of that name, else the first city of a county in the name. Null without one."""
    known = F.array(*(F.struct(F.lit(p[0].lower()).alias("city"), F.lit(p[1].lower().removesuffix(" county")).alias("county"), F.lit(float(p[2])).alias("lat"), F.lit(float(p[3])).alias("lng")) for p in PLACES))
    first = lambda a: F.try_element_at(a, F.lit(1))
    place = lambda name: F.coalesce(first(F.filter(known, lambda p: p["city"] == name)), first(F.filter(known, lambda p: F.contains(name, p["county"]))))
    found = F.transform(areas, lambda a: let(F.lower(F.trim(F.element_at(F.split(a, ","), 1))), place))
    return let(first(F.filter(found, lambda p: p.isNotNull())), lambda p: F.when(p.isNotNull(), F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))))


def backfill(catalogue: DataFrame) -> DataFrame:
    """catalogue(name, description, excerpt, eligibility, overridden, ...) with `backfilled`: rules that the stored evidence states, where a record has none and no review set any."""
    c = F.col
    names = catalogue.schema["eligibility"].dataType.names
    none = ~F.coalesce(*(F.when(c(f"eligibility.{n}").isNotNull(), F.lit(True)) for n in names), F.lit(False))
    rules = eligibility(evidence(c("name"), c("description"), c("excerpt")))
    stated = F.struct(*((rules[n] if n in RULES else F.lit(None)).cast(catalogue.schema["eligibility"].dataType[n].dataType).alias(n) for n in names))
    with_rules = catalogue.withColumn("_stated", F.when(none & ~F.coalesce(c("overridden"), F.lit(False)), stated))
    any_ = F.coalesce(*(F.when(c(f"_stated.{n}").isNotNull(), F.lit(True)) for n in names), F.lit(False))
    return with_rules.withColumn("backfilled", any_).withColumn("eligibility", F.when(any_, c("_stated")).otherwise(c("eligibility"))).drop("_stated")


#: The rules that page texts can state.
RULES = ["max_annual_income", "max_ami_percent", "max_fpl_percent", "requires_eviction_notice", "requires_children", "requires_veteran", "housing_status_any_of", "notes"]


def leads(links: DataFrame, most_depth: int) -> DataFrame:
    """(url, found_from, reason, kind, text): links(url, found_from, text, navigation, owner, depth) that won't be fetched but are worth a look, once for each page that they are on.

    Documents and links that no source owns are kept if they are useful, links that lie too deep if they aren't in a menu.
    Traps, assets and urls without a normal form are no leads; of several links of a page to one url the first text in order stays.
    """
    c = F.col
    url = normalize_url(c("url"))
    at = links.withColumn("_url", url).withColumn("kind", document_kind(c("_url"))).filter(c("_url").isNotNull() & ~crawl_trap(c("_url")) & (c("kind") != "asset"))
    menu = F.coalesce("navigation", F.lit(False))
    apart = F.when(c("kind") == "document", "document_needs_extraction").when(c("owner").isNull(), "outside_configured_sources")
    reason = F.when(apart.isNotNull(), F.when(useful_lead(c("_url"), menu), apart)).when((c("depth") > most_depth) & ~menu, "depth_limit")
    kept = at.withColumn("reason", reason).filter("reason is not null")
    return kept.groupBy(c("_url").alias("url"), "found_from").agg(F.min_by(F.struct("reason", "kind", "text"), F.struct("text", "reason")).alias("l")).select("url", "found_from", "l.*")


def known_needs(needs: Column) -> Column:
    """The categories among the needs, each once, in order; null as none."""
    return F.array_distinct(F.filter(F.coalesce(needs, F.array().cast("array<string>")), lambda n: n.isin(CATEGORIES)))


def picked_needs(picked: Column, read: Column) -> Column:
    """Needs picked by hand, then those read from the text; without a known one among the former the latter as they are."""
    return let(known_needs(picked), lambda p: F.when(F.size(p) > 0, F.array_union(p, F.coalesce(read, F.array().cast("array<string>")))).otherwise(read))


def indicators(stored: Column, found: Column) -> Column:
    """Stored signs of crisis, then those found now; stored ones never go."""
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(found, none)) > 0, F.array_union(F.coalesce(stored, none), found)).otherwise(stored)


def place_label(city: Column, county: Column, zip_: Column) -> Column:
    return F.coalesce(city, county, F.concat(F.lit("ZIP "), zip_), F.lit("Your location"))


def placement_counts(dots: DataFrame, areas: DataFrame) -> DataFrame:
    """(sit_id, exact, approximate, not_drawn): dots at an address, all others, and programmes of the state or the country without a dot near the person."""
    c = F.col
    d = dots.groupBy("sit_id").agg(F.count_if(c("placement") == "address").alias("exact"), F.count("*").alias("dots"), F.count_if(c("placement") == "near_you").alias("near"))
    wide = areas.groupBy("sit_id").agg(F.sum(F.when(c("place").isin("*statewide", "*national"), c("n")).otherwise(0)).alias("wide"))
    n = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return wide.join(d, "sit_id", "full").select("sit_id", n("exact").alias("exact"), (n("dots") - n("exact")).alias("approximate"), (n("wide") - n("near")).alias("not_drawn"))


def share_text(likely: Column, steps: Column, documents: Column, words: dict[str, str]) -> Column:
    """A plan as plain text: likely benefits as struct(title, value), numbered steps as struct(when, text, phone), documents to bring; parts without entries are left out. `words` has title, benefits, steps, docs, footer and each `when`."""
    w = {k: F.lit(v) for k, v in words.items()}
    none = F.array().cast("array<string>")
    when = lambda x: F.coalesce(F.element_at(F.create_map(*(y for k in ("now", "today", "week", "next") for y in (F.lit(k), w[k]))), x), F.lit(""))
    gains = F.transform(likely, lambda b: F.concat(F.lit("• "), b["title"], F.lit(": "), b["value"]))
    numbered = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". ["), when(s["when"]), F.lit("] "), s["text"], F.coalesce(F.concat(F.lit(" ("), F.when(s["phone"] != "", s["phone"]), F.lit(")")), F.lit(""))))
    boxes = F.transform(documents, lambda d: F.concat(F.lit("☐ "), d))
    part = lambda lines, before, after: F.when(F.size(F.coalesce(lines, none)) > 0, F.concat(F.array(*before), lines, F.array(*after).cast("array<string>"))).otherwise(none)
    empty = F.lit("")
    lines = F.concat(F.array(w["title"], empty), part(gains, [w["benefits"]], [empty]), F.array(w["steps"]), F.coalesce(numbered, none), part(boxes, [empty, w["docs"]], []), F.array(empty, w["footer"]))
    return F.array_join(lines, "\n")
