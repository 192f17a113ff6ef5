"""Helpers shared by the text operators: hashed words of Arrow batches, lineage cuts, joins whose broadcast side is measured first."""

from __future__ import annotations

import gc
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Bytes of text that one vectorised step holds.
BLOCK = 1 << 18
#: Rows of 8-byte keys that may be broadcast (16 MB); larger sides are shuffled.
BROADCAST_KEYS = 1 << 21

#: Longer words are hashed one by one.
LONG_WORD = 64
_MASK = np.array([2 ** (8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of other characters.
PUNCT = np.ones(256, bool)
PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_case(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return buf + ((buf - np.uint8(65)) < 26) * np.uint8(32)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, cased: bool = False) -> np.ndarray:
    """64-bit hashes of buf[start:end], of eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = np.concatenate([buf if cased else lower_case(buf), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", data, strides=(1,))
    sizes = ends - starts
    h = sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)
    rows = None if sizes.max() <= LONG_WORD else np.flatnonzero(sizes <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        at, left = (starts + k, sizes - k) if rows is None else (starts[rows] + k, sizes[rows] - k)
        x = (eight[at] & _MASK[np.minimum(left, 8)] ^ (h if rows is None else h[rows])) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        more = np.flatnonzero(left > 8)
        if rows is None:
            h, rows = x, more
        else:
            h[rows], rows = x, rows[more]
        if not len(rows):
            break
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return mix(h)


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers below 2^32 as compressed planes of their bytes; small ones take little room."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(4, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def text_blocks(texts: pa.Array, least: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about `least` bytes; nulls count as empty. One row is never divided."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if texts.null_count and np.any(np.diff(off)[np.asarray(texts.is_null())]):
        texts = pa.array(texts.fill_null("").to_pylist(), pa.large_string())
        yield from text_blocks(texts, least)
        return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + least, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    pa.default_memory_pool().release_unused()


def word_spans(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it (one entry more than rows)."""
    word = ~blanks(buf) if gap is SPACE else ~gap[buf]
    first, last = word.copy(), word.copy()
    if len(buf):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = off[(off > 0) & (off < len(buf))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def blanks(buf: np.ndarray) -> np.ndarray:
    """SPACE[buf]."""
    return (buf == 32) | ((buf - np.uint8(9)) < 5)


def hashed_words(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z in lower case, word counts before each row, starts, ends."""
    starts, ends, at = word_spans(buf, off, gap)
    return span_hashes(buf, starts, ends), at, starts, ends


def shingle_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k words; fewer words make one shingle of their own length, none makes none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(k, len(words))
    h = np.full(len(words) - n + 1, np.uint64((n * 0x632BE59BD9B4E019 + seed * 0x9E3779B97F4A7C15) % 2**64))
    for i in range(n):
        h = h * np.uint64(0xA24BAED4963EE407) + words[i : len(words) - n + 1 + i]
        h ^= h >> np.uint64(29)
    return mix(h)


class HashIndex:
    """Finds 64-bit hashes among sorted distinct ones by their upper bits; what it needs for that is built where it is used."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.first: np.ndarray | None = None

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, -1 if it isn't there."""
        bits = max(1, min(22, len(self.keys).bit_length()))
        shift = np.uint64(64 - bits)
        if self.first is None:
            self.first = np.concatenate([[0], np.cumsum(np.bincount((self.keys >> shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)
        slot = (h >> shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -1, np.int64)
        pos = np.flatnonzero(end > at)
        while len(pos):
            same = self.keys[at[pos]] == h[pos]
            out[pos[same]] = at[pos[same]]
            at[pos] += 1
            pos = pos[~same & (at[pos] < end[pos])]
        return out


def bounded(spark: SparkSession) -> None:
    """Arrow batches of 4 MB at most, unless the session already asks for less: whole texts are long, and JVM and Python each hold a few batches a task."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if now and int(now[1]) > most:
        spark.conf.set(key, str(most))


def shared(spark: SparkSession) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names; a local session without it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a reliable checkpoint: a lost executor costs no recomputation, later plans stay short."""
    shared(df.sparkSession)
    return df.checkpoint()


def placed(df: DataFrame, key: str) -> DataFrame:
    """cut, dealt by `key`; the plan is fixed beforehand, so that Spark still knows how the rows lie and joins on the key don't deal them again."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def forget(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of tables that nothing refers to any more, rather than when the driver's heap next fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stash(df: DataFrame) -> DataFrame:
    """The same rows read from Parquet in the checkpoint folder, which takes less room than a checkpoint of wide rows."""
    shared(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The same rows read from Parquet in the checkpoint folder, in buckets by `key`: a join on the key with a side dealt into as many parts leaves them where they are."""
    spark = df.sparkSession
    shared(spark)
    name = f"table_{uuid.uuid4().hex}"
    df.write.option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the catalogue forgets the name; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a stashed table."""
    jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(jsc.hadoopConfiguration()).delete(folder, True)


def few(df: DataFrame, most: int = BROADCAST_KEYS) -> bool:
    """Whether df, a checkpointed table of narrow rows, may be broadcast."""
    return df.count() <= most


def measured(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """df with a broadcast hint if its rows are few enough, else as it is, so that Spark shuffles both sides."""
    return F.broadcast(df) if few(df, most) else df


def ordered(df: DataFrame, order: list[Column], size: str) -> DataFrame:
    """df, checkpointed, with `before`: the sum of column `size` (whole numbers from 0) over all rows that come earlier in the order; rows that tie come in any order.

    Rows are dealt by ranges of the order with a number of each row as the last key, so that a value that many rows share
    fills many tasks. Each part is sorted and summed by itself; the driver gets one sum a part.
    """
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    last = [*order, F.col("_row")]
    parts = cut(rows.repartitionByRange(*last).sortWithinPartitions(*last).drop("_row").withColumn("_part", F.spark_partition_id()))
    sums = sorted(map(tuple, parts.groupBy("_part").agg(F.sum(size)).collect()))
    begin = dict(zip([p for p, _ in sums], itertools.accumulate([0, *(n for _, n in sums)]), strict=False))
    at, names = parts.columns.index(size), parts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            passed = begin[batch.column(len(names))[0].as_py()] if passed is None else passed
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(passed + np.cumsum(n) - n)], [*names, "before"])
            passed += int(n.sum())

    return parts.mapInArrow(run, StructType([*parts.schema.fields[:-1], StructField("before", LongType())]))


def crc_part(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
