"""Shards of nearly equal bytes: minimax contiguous partition of ordered groups of equal texts."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, measured

#: Bits of the key by which the first level of sums is taken, and by which a range is divided further.
FIRST_BITS, MORE_BITS = 12, 6
#: Rows that one task numbers.
PART_ROWS = 50_000


@dataclass(frozen=True, order=True)
class Run:
    """Sum over the groups whose key starts with the `bits` bits of `prefix`; single: it is one group."""

    first: int
    prefix: int
    bits: int
    size: int
    single: bool


class Packing:
    """Greedy passes over runs in order."""

    def __init__(self, runs: list[Run], shards: int):
        self.runs, self.shards = sorted(runs), shards
        self.sums = [0, *accumulate(r.size for r in self.runs)]

    def next_cut(self, at: int, capacity: int, divide: bool) -> int:
        """The byte at which a shard that starts at byte `at` ends. divide: runs of several groups may be cut anywhere."""
        to = at + capacity
        if to >= self.sums[-1]:
            return self.sums[-1]
        k = bisect_right(self.sums, to) - 1
        return to if divide and not self.runs[k].single else max(at, self.sums[k])

    def passes(self, capacity: int, divide: bool) -> list[int] | None:
        """The bytes at which shards end, or None if they are too many."""
        ends, at = [], 0
        while at < self.sums[-1]:
            to = self.next_cut(at, capacity, divide)
            if to == at or len(ends) == self.shards:
                return None
            ends.append(to)
            at = to
        return ends

    def smallest(self, divide: bool) -> int:
        lo, hi = max(1, -(-self.sums[-1] // self.shards)), self.sums[-1]
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.passes(mid, divide) is not None else (mid + 1, hi)
        return lo

    def unclear(self, lo: int, hi: int) -> list[Run]:
        """Runs of several groups in which a cut can fall for some capacity from lo to hi."""
        out, a, b = set(), 0, 0
        for _ in range(self.shards):
            a, b = self.next_cut(a, lo, False), self.next_cut(b, hi, True)
            k = max(0, bisect_right(self.sums, a) - 1)
            while k < len(self.runs) and self.sums[k] <= b:
                if not self.runs[k].single:
                    out.add(self.runs[k])
                k += 1
        return sorted(out)


def boundaries(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, keys at which the second and later shards begin) for groups(key, size) in the order of key; the capacity is the smallest possible.

    The driver holds sums over ranges of keys, never the groups: 4096 at first, then 64 for each range that is divided
    further, of which there are about the square of the shards. With ranges as atoms the search gives an upper bound; with
    ranges that can be cut anywhere, a lower one. Ranges that a cut can fall into are divided until both are equal.
    """

    def sums(df: DataFrame, bits: int) -> list[Run]:
        rows = df.groupBy(F.shiftright("key", 64 - bits).alias("range")).agg(F.sum("size").cast("long"), F.min("key"), F.max("key")).collect()
        return [Run(first, prefix, bits, size, first == last) for prefix, size, first, last in rows]

    runs = sums(groups, FIRST_BITS)
    while runs:
        p = Packing(runs, shards)
        lo, hi = p.smallest(True), p.smallest(False)
        if lo == hi:
            starts = dict(zip(p.sums, p.runs, strict=False))
            return hi, [starts[end].first for end in p.passes(hi, False)[:-1]]
        divided = p.unclear(lo, hi)
        for bits in {r.bits for r in divided}:
            ranges = groups.sparkSession.createDataFrame([(r.prefix,) for r in divided if r.bits == bits], "range long")
            here = groups.join(F.broadcast(ranges), F.shiftright("key", 64 - bits) == F.col("range"), "left_semi")
            runs += sums(here, min(64, bits + MORE_BITS))
        runs = [r for r in runs if r not in set(divided)]
    return 0, []


def balanced(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """boundaries(), with the shards evened out where one group is larger than an equal share.

    Such a group sets the capacity, and filling the other shards up to it would leave the last ones empty. There are fewer
    of them than shards. Each gets a shard of its own, and the stretches between them share the other shards in proportion
    to their bytes, each cut by boundaries(). Where that would raise the largest shard, the plain cuts stand.
    """
    plain = boundaries(groups, shards)
    total, large = groups.agg(F.sum("size")).first()[0] or 0, []
    while len(large) < shards:
        share = (total - sum(size for _, size in large)) / (shards - len(large))
        known = [key for key, _ in large]
        more = [tuple(r) for r in groups.filter((F.col("size") > share) & ~F.col("key").isin(known)).select("key", "size").collect()]
        if not more:
            break
        large = sorted(large + more)
    if not large or len(large) >= shards:
        return plain
    keys = [key for key, _ in large]
    stretch = F.size(F.filter(F.array(*map(F.lit, keys)), lambda k: k < F.col("key")))
    rest = groups.filter(~F.col("key").isin(keys)).withColumn("stretch", stretch)
    found = {r[0]: (r[1], r[2]) for r in rest.groupBy("stretch").agg(F.sum("size"), F.min("key")).collect()}
    free = shards - len(large)
    if len(found) > free:
        return plain
    own = dict.fromkeys(found, 1)
    for _ in range(free - len(found) if found else 0):
        own[max(own, key=lambda k: found[k][0] / own[k])] += 1
    capacity, begins = max(size for _, size in large), list(keys)
    for k, (_, first) in found.items():
        most, inner = boundaries(rest.filter(F.col("stretch") == k), own[k])
        capacity, begins = max(capacity, most), [*begins, first, *inner]
    return (capacity, sorted(begins)[1:]) if capacity == plain[0] else plain


def shard_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row: shards 0 to shards - 1 whose largest sum of sizes is as small as any contiguous cut allows.

    size: UTF-8 bytes of the text (null: none) plus 16. Equal texts form a group that stays in one shard; groups are
    ordered by a hash of their text. slot counts a shard's rows from 0 without gaps. A null text has a null checksum and
    is grouped with empty ones. Repeated rows are kept, each with its own slot. Fewer groups than shards leave shards
    empty. An empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").cast("long").alias("size")))
    _, begins = balanced(groups, shards)
    begin = F.array(*map(F.lit, begins)) if begins else F.array().cast("array<bigint>")
    placed = rows.withColumn("shard", F.size(F.filter(begin, lambda b: b <= F.col("key"))))

    # slots: rows of a shard are numbered in parts, and each part starts where the ones before it end
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // PART_ROWS))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "key")
    numbered = placed.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(measured(offsets, 1 << 19), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("own")).cast("long").alias("slot"))
