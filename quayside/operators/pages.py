"""Page tables: refresh from a fetch log, extraction of text, links and contacts, first-seen duplicates, ranked fetch lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.urls import crawl_trap, document_kind, link_priority, normalize_url
from .candidates import page_identity
from .dedup import checkpointed
from .page_reader import read_page

#: Bytes of pages that a task reads at once.
BATCH_BYTES = 4 << 20
#: Least size of a text by which pages are told to be the same.
SAME_TEXT = 80
#: What a start page is worth in the order of fetching.
SEED = 100_000
LINK = "struct<url:string,text:string,navigation:boolean,context:string,related:boolean>"
SCHEMA = (
    f"page_id long, url string, title string, description string, canonical string, headings array<string>, text string, excerpt string, links array<{LINK}>, phones array<string>, emails array<string>, "
    "content_hash string, text_size long, anchors int, truncated struct<text:boolean,excerpt:boolean,headings:boolean,links:boolean>"
)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, unless the session already asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """A record for each of pages(page_id, url, html), with the columns of `keep`; null html gives an empty record.

    The text is that of the main region: main elements, else articles, else an element named as content, else the body,
    without menus, headers and footers of the page, and sections that mostly link elsewhere. Links are full urls, each once,
    those of the main region first: against the page's base if that is of its own origin; with the text around them, and
    whether they stand in a menu or in a section that leads elsewhere. content_hash is of title and whole text; anchors counts
    all links, repeated ones too.

    What is kept is limited (60,000 characters of text, 1,000 links, 100 headings), unless all is wanted (`whole`); `truncated` says where.
    """
    small_batches(pages.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    read = schema.names[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_page(u, h, whole) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[c] for r in rows], schema.field(c).type) for c in read), *batch.columns[3:]], [*schema.names, *keep])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html", *keep)
    return rows.mapInArrow(run, StructType([*StructType.fromDDL(SCHEMA).fields, *rows.schema.fields[3:]]))


def page_keys(records: DataFrame) -> DataFrame:
    """(id, ord, key) of page records(page_id, url, title, description, excerpt, content_hash, text_size): what two pages that are the same one have in common. The final url, title and text if there is enough of it, name with description."""
    text = F.when(F.col("text_size") > SAME_TEXT, F.concat(F.lit("t"), "content_hash"))
    name = F.concat(F.lit("n"), F.sha2(page_identity(F.col("title"), F.col("description"), F.col("excerpt")), 256))
    url = F.concat(F.lit("u"), normalize_url(F.col("url")))
    keys = F.array_compact(F.array(url, text, name))
    return records.select(F.col("page_id").alias("id"), F.col("page_id").alias("ord"), F.explode_outer(keys).alias("key"))


def page_links(records: DataFrame) -> DataFrame:
    """(page_id, pos, url, text, navigation, context, related, kind): links of each page in normal form."""
    link = records.select("page_id", F.posexplode("links").alias("pos", "l")).select("page_id", "pos", "l.*")
    out = link.withColumn("url", normalize_url(F.col("url"))).filter("url is not null")
    return out.withColumn("kind", document_kind(F.col("url")))


def frontier(links: DataFrame, seeds: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, url, depth, score) of what links(found_from, url, text, navigation, source, ...) lead to from seeds(url, source): pages, no traps or assets, not farther than `depth` steps, with the best score of each url.

    A page's depth is the length of the shortest way from a seed, found level by level; each level is written down and
    joined with the links once, and only urls not met before go on. The score is the priority of the source in
    sources(source, priority), how much the link promises, and less for depth; seeds go first. Links without a source lead
    nowhere. Seeds are known by their normal form, so are pages.
    """
    c = F.col
    page = lambda u: (document_kind(u) == "page") & ~crawl_trap(u)
    edges = checkpointed(links.withColumns({"url": normalize_url(c("url")), "from": normalize_url(c("found_from"))}).filter(c("url").isNotNull() & c("source").isNotNull() & page(c("url"))).select("from", "url", "text", "navigation", "source"))
    start = checkpointed(seeds.withColumn("url", normalize_url(c("url"))).filter("url is not null").groupBy("url").agg(F.min("source").alias("source")))
    level = start.select("url", F.lit(0).alias("depth"))
    known, step = level, 0
    ways = edges.select(c("from").alias("_from"), c("url").alias("_to")).distinct()
    while step < depth - 1 and level.limit(1).count():
        step += 1
        level = checkpointed(level.join(ways, c("url") == c("_from")).select(c("_to").alias("url")).distinct().join(known, "url", "left_anti").withColumn("depth", F.lit(step)))
        known = known.unionByName(level)
    known = checkpointed(known)
    near = known.withColumnRenamed("url", "from")
    found = edges.join(near, "from").select("url", "source", (c("depth") + 1).alias("depth"), link_priority(c("url"), c("text"), c("navigation")).alias("promise"), F.lit(0).alias("seed"))
    first = start.select("url", "source", F.lit(0).alias("depth"), link_priority(c("url"), F.lit(""), F.lit(False)).alias("promise"), F.lit(SEED).alias("seed"))
    score = c("seed") + F.coalesce("priority", F.lit(0)) + 3 * c("promise") - 4 * c("depth")
    all_ = first.unionByName(found).join(F.broadcast(sources.select("source", "priority")), "source", "left").withColumn("score", score)
    return all_.groupBy("url").agg(F.min_by(F.struct("source", "depth", "score"), F.struct(-c("score"), c("depth"), c("source"))).alias("b")).select("b.source", "url", "b.depth", "b.score")


def fetch_list(found: DataFrame, per_source: int, total: int) -> DataFrame:
    """found(source, url, score, ...) with rank: the best `per_source` of each source, the best `total` in all. Both limits are the budget of a fetching round."""
    order = Window.partitionBy("source").orderBy(F.desc("score"), "url")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_source).orderBy(F.desc("score"), "source", "url").limit(total)


def refresh(stored: DataFrame, log: DataFrame) -> DataFrame:
    """The log(url, final_url, status, html, ...) with html filled in and `reused`: a 304 takes the stored html, if its final url is the same; other records their own; 304 without a stored page, and errors, go."""
    s = stored.select(F.col("url").alias("_url"), F.col("final_url").alias("_final"), F.col("html").alias("_html"))
    both = log.join(s, F.col("url") == F.col("_url"), "left")
    same = (F.col("status") == 304) & (F.col("final_url") == F.col("_final"))
    return both.filter(same | (F.col("status") == 200)).withColumn("reused", F.coalesce(same, F.lit(False))).withColumn("html", F.when(F.col("reused"), F.col("_html")).otherwise(F.col("html"))).drop("_url", "_final", "_html")
