"""Importance resampling towards a target: documents' hashed feature counts as bit planes, weighed by the bit planes of signed gains."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, bounded, cut, lower_case, measured, ordered, text_blocks, word_spans

BUCKETS = 10_000
#: Documents whose planes one step holds.
ROWS = 512
#: Longer spans are hashed one by one.
LONG_SPAN = 64


def crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & 1, np.uint32(0xEDB88320), np.uint32(0))
    return t


TABLE = crc_table()


def span_crc32(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of buf[start:end] for every span."""
    sizes = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    rows = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN))
    crc, at, left = out[rows], starts[rows], sizes[rows]
    while len(rows):
        crc = TABLE[(crc ^ buf[at]) & np.uint32(255)] ^ (crc >> np.uint32(8))
        at, left = at + 1, left - 1
        over = left == 0
        if over.any():
            out[rows[over]] = crc[over]
            rows, crc, at, left = rows[~over], crc[~over], at[~over], left[~over]
    out ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(sizes > LONG_SPAN).tolist():
        out[k] = zlib.crc32(buf[starts[k] : ends[k]])
    return out


def features(buf: np.ndarray, off: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of all runs of 1 to `most` words of each row, joined by one space, and the number of words of each row."""
    buf = lower_case(buf)
    starts, ends, at = word_spans(buf, off, PUNCT)
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    rows, found = [row], [span_crc32(buf, starts, ends) % buckets]
    if most > 1:
        sizes = ends - starts
        first = np.cumsum(sizes + 1) - sizes - 1
        line = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        line[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))] = buf[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        for k in range(2, most + 1):
            i = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
            rows.append(row[i])
            found.append(span_crc32(line, first[i], first[i + k - 1] + sizes[i + k - 1]) % buckets)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), np.diff(at)


def bucket_counts(docs: DataFrame, most: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task sends at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buf, off in text_blocks(batch.column(0)):
                n += np.bincount(features(buf, off, most, buckets)[1], minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the smoothed target share over the smoothed raw share) of each bucket."""
    own, all_ = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(scale * math.log((t + 1) * own / ((s + 1) * all_))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(power of two, plane) of two's complement; the plane of the sign has the negative power."""
    width = max(1, int(max(gain.max(initial=0), -gain.min(initial=0) - 1)).bit_length())
    planes = [(1 << j, packed((gain >> j & 1).astype(bool)[None])[0]) for j in range(width)]
    return [(power, p) for power, p in [*planes, (-(1 << width), packed((gain < 0)[None])[0])] if p.any()]


def plane_sums(row: np.ndarray, bucket: np.ndarray, n_rows: int, buckets: int, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The sum of the gains of each row's features: for each bit of the counts and of the gains, the set bits that both planes share, times both powers of two."""
    out = np.zeros(n_rows, np.int64)
    key, count = np.unique(row * buckets + bucket, return_counts=True)
    bit = 0
    while len(key):
        odd = key[(count & 1).astype(bool)]
        some, place = np.unique(odd // buckets, return_inverse=True)
        if len(some):
            own = np.zeros((len(some), buckets), bool)
            own[place, odd % buckets] = True
            own = packed(own)
            for power, plane in planes:
                out[some] += (np.bitwise_count(own & plane).sum(axis=1, dtype=np.int64) << bit) * power
        key, count, bit = key[count > 1], count[count > 1] >> 1, bit + 1
    return out


def weigh(docs: DataFrame, gain: np.ndarray, most: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the floored mean of the gains of its features, 0 without any."""
    planes, buckets = gain_planes(gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in text_blocks(batch.column(1)):
                row, bucket, words = features(buf, off, most, buckets)
                n = np.bincount(row, minlength=j - i)
                if len(row) and most > 1:
                    order = np.argsort(row, kind="stable")
                    row, bucket = row[order], bucket[order]
                total = np.zeros(j - i, np.int64)
                for k in range(0, j - i, ROWS):
                    of = slice(*np.searchsorted(row, [k, k + ROWS]))
                    total[k : k + ROWS] = plane_sums(row[of] - k, bucket[of], len(total[k : k + ROWS]), buckets, planes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, percent: int, least_words: int, seed: int) -> DataFrame:
    """weighed with score and rank: weight plus Gumbel noise of the document's own, and 1, 2, 3 ... for the floor(percent * N / 100) highest scores of the N rows with words enough.

    Scores are whole numbers in a range that the logarithms bound (some tens of thousands of values), so the smallest score
    that is drawn is found from one count a value. Only rows from that score on are put into order, by ranges.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = cut(weighed.withColumn("score", (F.col("weight") + noise).cast("long")))
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    counts = sorted(map(tuple, rows.filter(able).groupBy("score").count().collect()), reverse=True)
    left = most = percent * sum(n for _, n in counts) // 100
    least = None
    for score, n in counts:
        if left <= 0:
            break
        least, left = score, left - n
    top = able & (F.col("score") >= least) if least is not None else F.lit(False)
    none = F.lit(None).cast("long").alias("rank")
    placed = ordered(rows.filter(top).withColumn("one", F.lit(1)), [F.col("score").desc(), F.col("doc_id"), F.col("weight"), F.col("n_features")], "one") if least is not None else None
    rest = rows.filter(~F.coalesce(top, F.lit(False))).select("*", none)
    return rest if placed is None else rest.unionByName(placed.select(*rows.columns, F.when(F.col("before") < most, F.col("before") + 1).alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of docs(doc_id, text, ...); target(text, ...) is what the drawn documents should resemble.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. Features are hashed into
    buckets; a bucket's gain is the logarithm of its smoothed share in the target over that in docs, both counted over all
    whole texts. Drawing the highest sums of weight and Gumbel noise draws without replacement in proportion to
    exp(weight / 1000). The noise depends on seed and doc_id alone, so reruns agree; ties go to the smaller doc_id.

    Null and empty texts have no features and weight 0. Rows without doc_id have no noise: score and rank are null and they
    don't count among those to draw from. Repeated rows are ranked each. Other columns are ignored. A target without words
    gives gains from smoothing alone; an empty table gives an empty table.
    """
    bounded(docs.sparkSession)
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    return draw(weigh(docs, gain, most), percent, least_words, seed)


def drawn(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The drawn rows of docs, whole, with their rank; a doc_id that was drawn several times gives its rows each time."""
    chosen = ranks.filter("rank is not null").select("doc_id", "rank")
    return docs.drop("rank").join(measured(chosen), "doc_id")
