"""The pipeline's stages one after another, on a small corpus in which every decision is known."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

from .test_models import text


def test_stages_keep_clean_documents_and_drop_the_others(spark, tmp_path):
    rng = random.Random(11)
    good = [text(rng, "aa", 60) + "\n" + text(rng, "aa", 40) for _ in range(120)]
    item = text(rng, "bb", 14)
    docs = list(enumerate(good))
    docs += [(500 + i, "!!! ### BUY NOW " * 20) for i in range(30)]
    docs += [(600, good[3].replace(" ", "  ", 1)), (601, good[4] + " tail"), (602, good[5] + " " + item), (603, None), (604, "")]
    passage = "\n".join(text(rng, "cc", 20) for _ in range(4))
    docs += [(610 + i, text(rng, "aa", 50) + "\n" + passage + "\n" + text(rng, "aa", 50)) for i in range(3)]
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(500 + i, 0, 0) for i in range(0, 30, 2)]
    spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if k < 4:
            assert now.columns == corpus_pipeline.COLUMNS
    assert seen["quality"] >= set(range(120)) | {600, 601, 602, 610} and not seen["quality"] & set(range(500, 530))
    lines = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert passage in lines[610] and passage not in lines[611] and lines[0] == good[0]
    assert seen["line_dedup"] == seen["quality"]
    assert seen["line_dedup"] - seen["near_duplicates"] >= {600, 601} and seen["near_duplicates"] >= set(range(120)) | {610}
    assert not seen["decontamination"] & {602} and seen["decontamination"] >= set(range(120)) - {5}
    ids = spark.read.parquet(f"{tmp_path}/4").join(spark.read.parquet(f"{tmp_path}/3").select("doc_id", F.sha2("text", 256).alias("want")), "doc_id")
    assert ids.filter("decoded_sha256 <> want").count() == 0 and ids.count() == len(seen["decontamination"])
