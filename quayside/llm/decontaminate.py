"""Benchmark passages in documents: a prefix-filtered set join on the rarest shingle of each window, then exact containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, bounded, cut, hashed_words, mix, shingle_hashes, text_blocks

#: Words in a window, and in the shingles that a window is made of.
WINDOW, SHINGLE = 10, 3
#: Windows that are sent to the executors at once (some 100 bytes each); a larger benchmark goes over the documents in several blocks.
BLOCK_WINDOWS = 1_000_000


def run_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of words[start : start + width]."""
    h = np.full(len(starts), np.uint64(width * 0x632BE59BD9B4E019 % 2**64))
    for i in range(width):
        h = mix(h ^ words[starts + i]) + np.uint64(i)
    return h


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, width, window, shingles): the distinct windows of WINDOW consecutive words of each item; fewer words, but not none, are one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids = batch.column(0).to_pylist()
            for i, j, buf, off in text_blocks(batch.column(1)):
                words, at, _, _ = hashed_words(buf, off, PUNCT)
                for k in range(i, j):
                    own = words[at[k - i] : at[k - i + 1]]
                    if not len(own):
                        continue
                    width = min(WINDOW, len(own))
                    starts = np.arange(len(own) - width + 1)
                    hashes, sh, size = run_hashes(own, starts, width), signed(shingle_hashes(own, min(SHINGLE, width))), width - min(SHINGLE, width) + 1
                    out += [(ids[k], width, int(h), sh[s : s + size].tolist()) for h, s in zip(signed(hashes), starts, strict=True)]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))], ["item_id", "width", "window", "shingles"])

    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    return rows.mapInArrow(run, "item_id string, width int, window long, shingles array<long>").dropDuplicates(["item_id", "width", "window"])


class Lookup:
    """Which of many 64-bit hashes are in a sorted array; a table of their upper 16 bits answers for most."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.top = np.zeros(1 << 16, bool)
        self.top[(keys >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x that are found, and where in keys."""
        pos = np.flatnonzero(self.top[(x >> np.uint64(48)).astype(np.int64)])
        if not len(self.keys) or not len(pos):
            return pos[:0], pos[:0]
        at = np.minimum(np.searchsorted(self.keys, x[pos]), len(self.keys) - 1)
        hit = self.keys[at] == x[pos]
        return pos[hit], at[hit]


def document_counts(docs: DataFrame, vocabulary: DataFrame, sizes: list[int]) -> DataFrame:
    """(shingle, df): in how many documents each of the given shingles occurs, counted over all whole texts."""
    spark = docs.sparkSession
    keys = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in vocabulary.collect()], np.int64).view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(keys.value)
        df = np.zeros(len(find.keys), np.int64)
        for batch in batches:
            for _, _, buf, off in text_blocks(batch.column(0)):
                words, at, _, _ = hashed_words(buf, off, PUNCT)
                for k in sizes:
                    pos, key = find(shingle_hashes(words, k))
                    doc = np.searchsorted(at, pos, side="right") - 1
                    whole = pos + k <= at[doc + 1]
                    _, count = np.unique(np.unique(doc[whole] * len(find.keys) + key[whole]) % max(1, len(find.keys)), return_counts=True)
                    df[_] += count
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(find.keys[some].view(np.int64)), pa.array(df[some])], ["shingle", "df"])

    return docs.select("text").mapInArrow(run, "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df"))


def scan(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """docs(doc_id, text, n_words, spans, items) with what one block of windows adds: hit spans of words and items."""
    rows = prefixes.select("token", "offset", "width", "window", "item_id").collect()
    rows.sort(key=lambda r: r[0] & (2**64 - 1))
    table = docs.sparkSession.sparkContext.broadcast({
        "token": np.array([r[0] for r in rows], np.int64).view(np.uint64), "offset": np.array([r[1] for r in rows], np.int64), "width": np.array([r[2] for r in rows], np.int64),
        "window": np.array([r[3] for r in rows], np.int64).view(np.uint64), "item": [r[4] for r in rows], "sizes": sorted({min(SHINGLE, r[2]) for r in rows}),
    })
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        uniq, first, count = np.unique(t["token"], return_index=True, return_counts=True)
        find = Lookup(uniq)
        for batch in batches:
            n_words, spans, items = [], [list(map(tuple, (tuple(s.values()) for s in x))) for x in batch.column(3).to_pylist()], [set(x) for x in batch.column(4).to_pylist()]
            for i, _, buf, off in text_blocks(batch.column(1)):
                words, at, _, _ = hashed_words(buf, off, PUNCT)
                n_words += np.diff(at).tolist()
                for k in t["sizes"]:
                    pos, key = find(shingle_hashes(words, k))
                    # every window with that token, if it lies within the document
                    n = count[key]
                    entry = np.repeat(first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    start, doc = np.repeat(pos, n) - t["offset"][entry], np.repeat(np.searchsorted(at, pos, side="right") - 1, n)
                    fits = (start >= at[doc]) & (start + t["width"][entry] <= at[doc + 1]) & (np.minimum(SHINGLE, t["width"][entry]) == k)
                    entry, start, doc = entry[fits], start[fits], doc[fits]
                    for width in np.unique(t["width"][entry]):
                        of = np.flatnonzero(t["width"][entry] == width)
                        of = of[run_hashes(words, start[of], int(width)) == t["window"][entry[of]]]
                        for d, s, e in zip(doc[of].tolist(), (start[of] - at[doc[of]]).tolist(), entry[of].tolist(), strict=True):
                            spans[i + d].append((s, s + int(width)))
                            items[i + d].add(t["item"][e])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array([[{"start": s, "stop": e} for s, e in merged(x)] for x in spans], span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                ["doc_id", "text", "n_words", "spans", "items"],
            )

    return docs.mapInArrow(run, "doc_id long, text string, n_words long, spans array<struct<start:int,stop:int>>, items array<string>")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of docs: merged word spans inside windows of benchmark(item_id, text), and the items these come from.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. A window is contained if
    all its words occur in a row. So its rarest shingle, by the number of documents over the whole corpus, is the one
    prefix token that has to be joined; a window with a shingle that no document has is dropped at once. The token's place
    bounds where the window can lie; the words there are then compared.

    Null and empty texts have no words and no hits; items without words or id have no windows; repeated items count once
    each id. Repeated documents get the same result each. Other columns are ignored. Empty tables give no hits or no rows.
    """
    bounded(docs.sparkSession)
    windows = cut(item_windows(benchmark))
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = docs.select(F.col("doc_id").cast("long"), "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for b in range(blocks):
        own = windows.filter(F.col("block") == b)
        sizes = sorted(min(SHINGLE, r[0]) for r in own.select("width").distinct().collect())
        shingles = own.select("item_id", "width", "window", F.posexplode("shingles").alias("offset", "token"))
        df = cut(document_counts(docs, shingles.select("token").distinct(), sorted(set(sizes))))
        rare = shingles.join(df.withColumnRenamed("shingle", "token"), "token", "left").groupBy("item_id", "width", "window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset")).alias("t"))
        out = scan(out, rare.filter("t.df > 0").select("item_id", "width", "window", "t.token", "t.offset"))
    return out.drop("text")
