"""Orders of whole tables by the rules of language, with the place of every row."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dedup import checkpointed

#: Bits of a row's number within its part.
BITS = 33


def by_language(name: str) -> Column:
    """A text as an order key: letters before their accented forms, either case side by side; null as empty."""
    return F.expr(f"coalesce({name}, '') COLLATE UNICODE")


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """df with `place`, from 1 in the given order; rows that tie come in any order.

    Rows are dealt by ranges of the order and sorted within; a part's places begin where the parts before it end. So no
    task sees the whole table, and the driver only one count a part. The number of each row ends the order, so that a
    value which many rows share is dealt too.
    """
    rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    last = [*order, F.col("_row")]
    parts = checkpointed(rows.repartitionByRange(*last).sortWithinPartitions(*last).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", BITS)
    counts = sorted(map(tuple, parts.groupBy(part.alias("part")).count().collect()))
    begin = list(zip([p for p, _ in counts], accumulate([0, *(n for _, n in counts)]), strict=False))
    offsets = df.sparkSession.createDataFrame(begin, "_part long, _before long")
    placed = parts.join(F.broadcast(offsets), part == F.col("_part"))
    return placed.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << BITS) - 1) + 1).drop("_at", "_part", "_before")


def catalogue_order(resources: DataFrame) -> DataFrame:
    """resources(id, name, ...) with their place by name, then id."""
    return in_order(resources, by_language("name"), by_language("id"))


def candidate_order(candidates: DataFrame) -> DataFrame:
    """candidates(name, source_url, ...) with their place by name, then url."""
    return in_order(candidates, by_language("name"), by_language("source_url"))


def area_order(areas: DataFrame) -> DataFrame:
    """areas(sit_id, place, n, ...) with `rank`: each person's counties, those with most programmes first, then by name; the lists without a county aren't ranked."""
    order = Window.partitionBy("sit_id").orderBy(F.desc("n"), by_language("place"))
    return areas.filter("not startswith(place, '*')").withColumn("rank", F.row_number().over(order))
