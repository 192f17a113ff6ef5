"""Mixing sources to target weights: fixed-length blocks of words, multinomial source counts of each output shard, pseudorandom index permutations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, measured, mix, ordered

#: Words of a block.
BLOCK = 256
#: Shards of the output.
SHARDS = 40
#: Rounds of the permutation's network.
ROUNDS = 4

WORD = r"[^\x20\x09-\x0D]+"


def filled(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """What each source gives if they share the sum of all sizes by weight, none gives more than `most` times its size, and the excess is shared again by weight until none is above."""
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        share = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * share > most * sizes[k]]
        if not full:
            for k in open_:
                target[k] = weights[k] * share
            break
        for k in full:
            target[k] = float(most * sizes[k])
        left -= sum(target[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return target


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each x, from 0 to n - 1, in the permutation of 0 to n - 1 that key names: a Feistel network over the next even power of two, walked until the place is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, key = x.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right, h, m = out[todo] >> half[todo], out[todo] & mask[todo], half[todo], mask[todo]
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right + mix(key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class Source:
    """One source: where its words begin in the order of all sources, and the slots that it fills. The last slot ends where the target is met."""

    name: str | None
    size: int
    target: float
    first: int
    key: int
    block: int

    def __post_init__(self) -> None:
        words = round(self.target)
        self.full, rest = divmod(self.size, self.block)
        self.blocks = self.full + (rest > 0)
        epochs, more = divmod(words, self.size) if self.size else (0, 0)
        own = -(-more // self.block) if more <= self.full * self.block else self.blocks
        self.slots = epochs * self.blocks + own
        last = self.block if not rest or own <= self.full else rest
        self.last = more - (own - 1) * self.block if own else (rest or last)
        self.rest = rest


def source_key(name: str | None, seed: int) -> int:
    return int.from_bytes(blake2b(b"" if name is None else b"+" + name.encode(), digest_size=8, key=str(seed).encode()).digest(), "little")


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: multinomial draws by what each source has left. Draws beyond that are drawn again among the others, so that the last shard meets every source's number of slots."""
    left = np.array(slots, np.int64)
    rng, total = np.random.default_rng(seed), int(left.sum())
    out = np.zeros((shards, len(slots)), np.int64)
    for k in range(shards):
        need = total * (k + 1) // shards - total * k // shards
        while need:
            n = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += n
            left, need = left - n, need - int(n.sum())
    return out


@dataclass
class Mixture:
    """sources: one for each distinct source. rows: the documents with n_words, source_no, source_size, target and `start`, their first word's place in the source.

    slots(shard, slot, source_no, block, copy, n_words): which block of which source stands there, for the how-manieth
    time, and how many of its words count. pieces(rows' columns, source_no, block, first, stop, word): the words of a block
    that a document holds, and the first one's place in the document.
    """

    sources: list[Source]
    rows: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def blocks(self) -> DataFrame:
        """(shard, slot, source_no, block, copy, first, word, words, doc_id): the documents' words in each slot."""
        words = F.least("stop", "n_words") - F.col("first")
        own = self.pieces.select("source_no", "block", "first", "stop", "word", "doc_id")
        return self.slots.join(own, ["source_no", "block"]).withColumn("words", words).filter("words > 0").drop("stop", "n_words")

    def taken(self) -> DataFrame:
        """rows with `taken`: the words that the mixture takes of each, repeats counted."""
        times = self.slots.groupBy("source_no", "block", "n_words").count()
        words = F.greatest(F.least("stop", F.col("end")) - F.col("first"), F.lit(0)) * F.col("count")
        used = self.pieces.join(times.withColumnRenamed("n_words", "end"), ["source_no", "block"], "left")
        some = used.groupBy(*self.rows.columns).agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"))
        return some.unionByName(self.rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))

    def texts(self, docs: DataFrame) -> DataFrame:
        """(shard, slot, source_no, text): each slot's words, joined by single blanks, from docs with distinct doc_ids."""
        words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
        part = F.array_join(F.slice("all", F.col("word").cast("int") + 1, F.col("words").cast("int")), " ")
        own = self.blocks().join(docs.select("doc_id", words.alias("all")), "doc_id").select("shard", "slot", "source_no", F.struct("first", part.alias("part")).alias("p"))
        return own.groupBy("shard", "slot", "source_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["part"]), " ").alias("text"))


def mix_sources(docs: DataFrame, weight: Callable[[int], float] = lambda k: k % 3 + 1, most: float = 3, block: int = BLOCK, shards: int = SHARDS, seed: int = 11) -> Mixture:
    """Mixes docs(doc_id, text, source, ...) so that its sources, in the order of their code points and null last, share as many words as there are in the proportion of weight(0), weight(1) ...

    Words are runs of other characters than ASCII white space. No source gives more than `most` times its words, and so no
    document does. A source's documents, in the order of doc_id, are packed into blocks of `block` words; its last block
    may be shorter. Each shard draws how many of its slots each source fills. A source's slots go through all its blocks
    in one pseudorandom order, then through all in another, the short block at the end of each; so a document's copies
    differ by one at most in each block. The last slot is cut where the target is met.

    Draws and orders depend on seed, names and sizes alone: reruns agree. Null and empty texts have no words and aren't
    taken. A null doc_id counts as the first one; rows alike in all but their text are ordered by a hash of it, equal rows
    are taken one after another. Other columns are ignored. An empty table gives an empty mixture.

    Scale: the driver holds one entry a source and one count a source and shard.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("mark"))
    placed = cut(ordered(rows, [F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("size"), F.col("mark")], "size"))
    found = placed.groupBy("source").agg(F.sum("size"), F.min("before")).collect()
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    targets = filled([r[1] for r in found], [weight(k) for k in range(len(found))], most)
    sources = [Source(name, size, target, first, source_key(name, seed), block) for (name, size, first), target in zip(found, targets, strict=True)]

    spark = docs.sparkSession
    known = spark.createDataFrame([(k, s.name, s.size, s.target, s.first) for k, s in enumerate(sources)], "source_no int, source string, source_size long, target double, begin long")
    own = placed.join(measured(known.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name")))
    own = own.select("doc_id", "source", "size", "source_no", "source_size", "target", (F.col("before") - F.col("begin")).alias("start"))
    end = F.col("start") + F.col("size")
    pieces = own.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    begin = F.col("block") * block
    pieces = pieces.withColumns({"first": F.greatest("start", begin) - begin, "stop": F.least(end, begin + block) - begin, "word": F.greatest("start", begin) - F.col("start")})

    counts = shard_counts([s.slots for s in sources], shards, seed) if sources else np.zeros((shards, 0), np.int64)
    runs = np.concatenate([[0], np.cumsum(counts.ravel())])
    before = (np.cumsum(counts, axis=0) - counts).ravel()
    of = {f: np.array([getattr(s, f) for s in sources], np.uint64 if f == "key" else np.int64) for f in ("slots", "blocks", "full", "rest", "last", "key")}
    limits = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(0).to_numpy()
            at = np.searchsorted(runs, g, side="right") - 1
            shard, src = at // len(of["slots"]), at % len(of["slots"])
            j = before[at] + g - runs[at]
            copy, i = j // of["blocks"][src], j % of["blocks"][src]
            full = np.maximum(of["full"][src], 1)
            b = np.where(i < of["full"][src], permuted(np.minimum(i, full - 1), full, of["key"][src] + mix(copy.astype(np.uint64))), i)
            n = np.where(j == of["slots"][src] - 1, of["last"][src], np.where(b < of["full"][src], block, of["rest"][src]))
            many = limits[shard + 1] - limits[shard]
            slot = permuted(g - limits[shard], many, mix(shard.astype(np.uint64) + np.uint64(seed)))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(slot), pa.array(src, pa.int32()), pa.array(b), pa.array(copy), pa.array(n)], ["shard", "slot", "source_no", "block", "copy", "n_words"])

    slots = spark.range(int(runs[-1])).mapInArrow(run, "shard int, slot long, source_no int, block long, copy long, n_words long")
    return Mixture(sources, own, slots, pieces)
