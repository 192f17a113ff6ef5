"""First-seen duplicates where a row that is dropped doesn't count as seen."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df read from a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def first_seen(keys: DataFrame) -> DataFrame:
    """(id, ord, kept, of) for keys(id, ord, key): rows in the order of (ord, id), kept unless they share a key with a kept row before; `of` is the first such row's id.

    Each round keeps the rows that come first among the undecided ones in all of their keys, and drops those that share a
    key with them. Rounds are joins and sums by key, so a key that a third of all rows has costs no task more than its
    part of the rows. Null keys mark nothing; a row with only null keys is kept.
    """
    at = F.struct("ord", "id")
    rows = keys.groupBy("id").agg(F.min("ord").alias("ord"))
    marks = checkpointed(keys.filter("key is not null").select("id", "ord", "key").distinct())
    open_, done = marks, None
    while open_.limit(1).count():
        first = open_.groupBy("key").agg(F.min(at).alias("first"))
        placed = open_.join(first, "key").withColumn("leads", at == F.col("first"))
        kept = placed.groupBy("id").agg(F.min("leads").alias("all")).filter("all").select("id")
        seen = checkpointed(open_.join(kept, "id").groupBy("key").agg(F.min(at).alias("by")))
        lost = open_.join(seen, "key").groupBy("id").agg(F.min("by").alias("by"))
        now = checkpointed(lost.select("id", (F.col("by.id") == F.col("id")).alias("kept"), F.col("by.id").alias("of")))
        done = now if done is None else done.unionByName(now)
        open_ = checkpointed(open_.join(now, "id", "left_anti"))
    if done is None:
        return rows.select("id", "ord", F.lit(True).alias("kept"), F.col("id").alias("of"))
    return rows.join(done, "id", "left").select("id", "ord", F.coalesce("kept", F.lit(True)).alias("kept"), F.coalesce("of", "id").alias("of"))

