"""From raw documents to token ids: quality, repeated passages, near duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns the columns of
`documents`; the last returns ids. Stages are written as Parquet and read again. Null texts count as empty ones, repeated
rows as further documents with the same id; tables without rows give tables without rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import bpe, decontaminate, line_dedup, minhash, quality
from quayside.llm.common import shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality.rank(docs.select(COLUMNS), model).filter("predicted = 1").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without later occurrences of repeated passages of three lines or more, as far as any line is left; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS)).filter("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words with a similarity of 0.8 or more: the one with the smallest id."""
    kept = minhash.near_duplicates(docs, shingle=5, percent=80).filter("kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(kept, "doc_id", "left_semi").select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.filter(F.size("items") > 0).select("doc_id").distinct()
    return docs.select(COLUMNS).join(hit, "doc_id", "left_anti").select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): ids as little-endian unsigned 32-bit integers, and checksums of them and of the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode(docs, path, decoded=True)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("encoding", encoding_stage)]

#: SQL can't express the classifier; tests/llm holds the stages against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what lies between them is written to the shared checkpoint folder."""
    shared(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
