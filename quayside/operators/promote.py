"""Candidates and reviewed overrides to a catalogue: merging, re-keying, carrying forward, validation, statistics."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.urls import url_key
from ..sources.dimensions import CATEGORIES, HOUSING_STATUSES
from .catalogue import existing

#: Forms of a service area: the country, the state, counties or a city with the state.
SERVICE_AREA = r"^(?:US|California|[A-Z][\w .'-]+(?: and [A-Z][\w .'-]+)*(?: count(?:y|ies))?, CA)$"
LIMITS = ["max_annual_income", "max_ami_percent", "max_fpl_percent"]
RULES = [*LIMITS, "requires_eviction_notice", "requires_children", "requires_veteran", "housing_status_any_of", "notes"]
#: Fields that a review may set one by one.
FIELDS = ["active", "phone", "address", "response_time_days", "required_documents", "description", "application_url", "source_url"]


def read_candidate_sets(spark: SparkSession, paths: list[str], fields: str) -> list[DataFrame]:
    """A table for each of the candidate files that exist: JSON objects {generatedAt, candidates}, each candidate with `ord`, its place, and with `generated_at` and `file_path`, where it comes from."""
    out = []
    schema = f"generatedAt string, candidates array<struct<{fields}>>"
    for path in existing(spark, paths):
        whole = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path).select("generatedAt", "candidates", F.col("_metadata.file_path").alias("file_path"))
        out.append(whole.select(F.col("generatedAt").alias("generated_at"), "file_path", F.posexplode("candidates").alias("ord", "c")).select("ord", "generated_at", "file_path", "c.*"))
    return out


def latest_date(sets: list[DataFrame]) -> DataFrame:
    """One row: the latest `generated_at` of all the sets' rows, also of those that merging drops; null without any."""
    dates = [s.select(F.max("generated_at").alias("generated_at")) for s in sets]
    return reduce(DataFrame.unionByName, dates).agg(F.max("generated_at").alias("generated_at"))


def merge_candidate_sets(sets: list[DataFrame]) -> DataFrame:
    """The rows of several candidate tables in order; the first row of an id wins. Columns that a table lacks are null."""
    all_ = None
    for k, s in enumerate(sets):
        s = s.withColumn("file_ord", F.lit(k))
        all_ = s if all_ is None else all_.unionByName(s, allowMissingColumns=True)
    order = Window.partitionBy("id").orderBy("file_ord", "ord")
    return all_.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def rekey(overrides: DataFrame, candidates: DataFrame, previous: DataFrame) -> DataFrame:
    """(id, new_id) for overrides whose id no candidate has: the candidate whose source or canonical url is that of the previous record; the last one if several are; null if none is."""
    stale = overrides.select("id").join(candidates.select("id"), "id", "left_anti")
    urls = candidates.select("id", "ord", F.posexplode(F.array("source_url", "canonical_url")).alias("k", "url")).filter("url is not null and url <> ''")
    by_url = urls.groupBy(url_key(F.col("url")).alias("key")).agg(F.max_by("id", F.struct("ord", "k")).alias("new_id"))
    old = previous.select("id", url_key(F.col("source_url")).alias("key"))
    return stale.join(old, "id", "left").join(by_url, "key", "left").select("id", "new_id")


def has_rules() -> Column:
    return F.coalesce(*(F.when(F.col(r).isNotNull(), F.lit(True)) for r in RULES), F.lit(False))


def resource_errors() -> Column:
    """Messages on what is wrong with a record."""
    c = F.col
    tests = [F.when(F.coalesce(F.trim(f), F.lit("")) == "", F.lit(f"{f} is required")) for f in ("id", "name", "organization", "description", "application_url", "source_url")]
    tests.append(F.when(~F.coalesce(c("category").isin(CATEGORIES), F.lit(False)), F.concat(F.lit("unknown category "), F.coalesce("category", F.lit("")))))
    tests.append(F.when(F.coalesce(F.size("service_area"), F.lit(0)) <= 0, F.lit("service_area is empty")))
    tests.append(F.when(F.exists("service_area", lambda a: ~a.rlike(SERVICE_AREA)), F.lit("service_area has an unknown form")))
    tests.append(F.when(c("active").isNull(), F.lit("active is required")))
    tests += [F.when((F.trim(f) != "") & ~c(f).rlike(r"(?i)^https?://[^\s/?#]+"), F.lit(f"{f} is not a url")) for f in ("application_url", "source_url")]
    tests.append(F.when(c("response_time_days") < 0, F.lit("response_time_days is negative")))
    tests += [F.when(~(c(f) > 0), F.lit(f"{f} must be positive")) for f in LIMITS]
    tests.append(F.when(F.exists("housing_status_any_of", lambda s: ~s.isin(HOUSING_STATUSES)), F.lit("housing_status_any_of has an unknown status")))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def override_errors(overrides: DataFrame) -> DataFrame:
    c = F.col
    tests = F.array(
        F.when((F.coalesce("reviewed_at", F.lit("")) == "") | (F.coalesce("reviewed_by", F.lit("")) == ""), F.lit("reviewed_at and reviewed_by are required")),
        F.when(F.coalesce("exclude", F.lit(False)) & (F.coalesce("exclude_reason", F.lit("")) == ""), F.lit("exclude needs a reason")),
        F.when(F.exists(F.array(*(c("rules")[f] for f in LIMITS)), lambda x: ~(x > 0)), F.lit("a limit must be positive")),
    )
    return overrides.select(F.concat(F.lit("override "), "id").alias("id"), F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("error"))


@dataclass
class Promotion:
    """resources: the new catalogue; errors(id, error); warnings(id, kind, other); outcomes(id, ord, outcome); stats: one row."""

    resources: DataFrame
    errors: DataFrame
    warnings: DataFrame
    outcomes: DataFrame
    stats: DataFrame


def promote(candidates: DataFrame, overrides: DataFrame, previous: DataFrame, more_errors: DataFrame | None = None) -> Promotion:
    """Applies overrides(id, ord, reviewed_at, reviewed_by, exclude, exclude_reason, eligibility_verified, rules, FIELDS...) to candidates in order.

    Overrides with an id that is gone follow their page to its new id, or keep the previous record, flagged, if the page is
    gone too. A candidate without a category is skipped; one whose id came before is an error; an excluded one is dropped;
    the others take the reviewed fields, and reviewed rules as a whole. Null in an override means "not reviewed".
    more_errors(id, error), such as those of reviews as they were written, count as errors of the promotion.
    """
    c = F.col
    keys = rekey(overrides, candidates, previous)
    of = overrides.join(keys.withColumnRenamed("id", "_id"), c("id") == c("_id"), "left").withColumn("stale", c("_id").isNotNull())
    last = Window.partitionBy(F.coalesce("new_id", "id")).orderBy(F.desc("ord"))
    used = of.filter("not stale or new_id is not null").withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    review = used.select(F.coalesce("new_id", "id").alias("id"), F.struct(*(x for x in overrides.columns if x not in ("id", "ord"))).alias("o"))
    gone = of.filter("stale and new_id is null and not coalesce(exclude, false)").select("id")
    carried = previous.join(gone, "id", "left_semi").withColumn("carried_forward", F.lit(True))

    order = Window.partitionBy("id").orderBy("ord")
    named = candidates.filter("category is not null").join(carried.select("id", F.lit(True).alias("kept")), "id", "left").withColumn("again", (F.row_number().over(order) > 1) | F.coalesce("kept", F.lit(False))).drop("kept")
    seen = named.unionByName(candidates.filter("category is null"), allowMissingColumns=True).join(review, "id", "left")
    outcome = F.when(c("category").isNull(), "uncategorised").when(c("again"), "duplicate").when(F.coalesce(c("o.exclude"), F.lit(False)), "excluded").otherwise("promoted")
    judged = seen.withColumn("outcome", outcome)
    reviewed = c("o.rules").isNotNull()
    fields = {f: F.coalesce(c(f"o.{f}"), c(f)) for f in FIELDS}
    rules = {r: F.when(reviewed, c(f"o.rules.{r}")).otherwise(c(r)) for r in RULES}
    verified = F.when(reviewed, F.coalesce(c("o.eligibility_verified"), F.lit(True))).otherwise(F.coalesce(c("o.eligibility_verified"), c("eligibility_verified"), F.lit(False)))
    new = judged.filter("outcome = 'promoted'").withColumns(fields | rules | {"eligibility_verified": verified, "last_verified": F.coalesce(c("o.reviewed_at"), c("last_verified"))})
    new = new.withColumn("carried_forward", F.lit(False)).drop("o", "again", "outcome")
    resources = new.unionByName(carried, allowMissingColumns=True).drop("canonical_url")

    bad = resources.select("id", F.explode(resource_errors()).alias("error"))
    errors = bad.unionByName(judged.filter("outcome = 'duplicate'").select("id", F.lit("duplicate id").alias("error"))).unionByName(override_errors(overrides))
    errors = errors if more_errors is None else errors.unionByName(more_errors.select("id", "error")).distinct()
    link = Window.partitionBy(F.lower("application_url")).orderBy("ord", "id")
    shared = new.filter("application_url is not null").withColumn("other", F.first("id").over(link)).filter("id <> other").select("id", F.lit("shares application_url").alias("kind"), "other")
    renamed = keys.filter("new_id is not null").select("id", F.lit("re-keyed").alias("kind"), c("new_id").alias("other"))
    kept = carried.select("id", F.lit("carried forward").alias("kind"), F.lit(None).cast("string").alias("other"))
    lost = gone.join(previous, "id", "left_anti").select("id", F.lit("ignored").alias("kind"), F.lit(None).cast("string").alias("other"))
    warnings = shared.unionByName(renamed).unionByName(kept).unionByName(lost)

    count = lambda test, name: F.coalesce(F.sum(test.cast("long")), F.lit(0)).alias(name)
    by = judged.agg(F.count("*").alias("candidates"), *(count(c("outcome") == o, o) for o in ("uncategorised", "duplicate", "excluded")))
    made = resources.agg(
        F.count("*").alias("promoted"), count(c("eligibility_verified"), "verified"), count(has_rules(), "with_eligibility"), count(has_rules() & ~F.coalesce("eligibility_verified", F.lit(False)), "backfilled"),
        count(~F.coalesce("active", F.lit(False)), "inactive"), count(c("carried_forward"), "carried_forward"),
    )
    stats = by.crossJoin(made).crossJoin(keys.agg(count(c("new_id").isNotNull(), "rekeyed")))  # three tables of one row
    return Promotion(resources, errors, warnings, judged.select("id", "ord", "outcome"), stats)


def switch(spark: SparkSession, folder: str, version: str) -> None:
    """Makes a version the current one: its name is written beside the pointer file, which it then replaces in one step. (In a store without atomic renaming, that step is as atomic as the store makes it.)"""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, path = jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Path
    new, now = path(f"{folder}/pointer-{version}"), path(f"{folder}/current")
    out = now.getFileSystem(conf).create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fs.FileContext.getFileContext(now.toUri(), conf).rename(new, now, how)


def current_version(spark: SparkSession, folder: str) -> str | None:
    found = existing(spark, [f"{folder}/current"])
    return spark.read.text(found[0]).first()[0] if found else None


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The catalogue that was published last in a folder, None if none was."""
    version = current_version(spark, folder)
    return None if version is None else spark.read.parquet(f"{folder}/{version}/resources")


def publish(p: Promotion, folder: str) -> int:
    """Publishes a promotion in a folder, all or nothing; returns the number of its errors.

    Everything is written to a new version's own folder first: errors, warnings, then, only if there is no error, the
    resources. Only when these are complete the pointer moves to them. A job that ends before that, or has errors, leaves
    the catalogue of before in place; readers see one version or the other.
    """
    spark, version = p.errors.sparkSession, uuid.uuid4().hex
    p.errors.write.parquet(f"{folder}/{version}/errors")
    p.warnings.write.parquet(f"{folder}/{version}/warnings")
    n = spark.read.schema(p.errors.schema).parquet(f"{folder}/{version}/errors").count()
    if not n:
        p.resources.write.parquet(f"{folder}/{version}/resources")
        switch(spark, folder, version)
    return n
