"""Near-duplicate documents by SetSketch registers: exponentially spaced truncated minima, banded, jointly estimated, verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, hashed_words, measured, mix, shingle_hashes, text_blocks
from .components import components

#: SetSketch's parameters: base of the spacing, rate of the exponentials, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Registers in a band, and the chance that a pair at the threshold shares no band.
ROWS, MISS = 4, 1e-6
#: A candidate goes only if its registers are e^20 times likelier under a similarity below the threshold.
EVIDENCE = 20.0
#: Sets, and shingles in them, of a block; two blocks are compared in one task.
BLOCK_SETS, BLOCK_SHINGLES = 512, 250_000
#: Pairs with one hub that a task gets at once.
COPY = 128


def bands_for(threshold: float) -> int:
    """Bands that a pair at the threshold misses altogether with a chance of at most MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def _constants(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(1, 2**63, (m, 1), dtype=np.uint64), rng.integers(1, 2**63, (m, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(shingles: np.ndarray, xors: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """A set's registers: floor(1 - log_b x) of the smallest exponential variate x over the set, cut to 0..TOP. max() of two sketches is their union's."""
    least = np.full(len(xors), 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        x = shingles[None, i : i + 4096] ^ xors
        x *= odds
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP).astype(">u2")


def text_hash() -> Column:
    """Tells apart the texts of one doc_id."""
    return F.xxhash64("text")


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, text) for ids(rep, doc_id, text_hash)."""
    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text")
    return rows.join(measured(ids), (rows["doc_id"].eqNullSafe(ids["doc_id"])) & (rows["text_hash"] == ids["text_hash"])).select("rep", "text").dropDuplicates(["rep"])


def sketches(docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(doc_id, text_hash, n_shingles, h1, h2, registers) of each row's whole text; h1 and h2 are sums over the set, alike for equal sets only."""
    m = bands_for(threshold) * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xors, odds = _constants(m)
        for batch in batches:
            n, h1, h2, reg = [], [], [], []
            for i, j, buf, off in text_blocks(batch.column(1)):
                words, at, _, _ = hashed_words(buf, off)
                for k in range(j - i):
                    s = np.unique(shingle_hashes(words[at[k] : at[k + 1]], shingle))
                    n.append(len(s))
                    h1.append(int(mix(s ^ np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                    h2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    reg.append(registers(s, xors, odds).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(reg, pa.binary())], ["doc_id", "text_hash", "n_shingles", "h1", "h2", "registers"])

    return docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, registers binary")


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for i, j, buf, off in text_blocks(texts):
        words, at, _, _ = hashed_words(buf, off)
        for k in range(j - i):
            yield np.unique(shingle_hashes(words[at[k] : at[k + 1]], shingle))


def log_likelihood(j: np.ndarray, u: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of similarity j, given u (the first set's share of both sizes) and how many registers are larger, smaller and equal."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    v = 1 - u
    a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))


def plausible(n1, n2, r1: np.ndarray, r2: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the likeliest similarity reaches the threshold, or doesn't beat the best one that does by EVIDENCE."""
    u = n1 / (n1 + n2)
    top = np.minimum(n1, n2) / np.maximum(n1, n2)  # no larger similarity is possible
    d = (r1 > r2).sum(axis=1), (r1 < r2).sum(axis=1), (r1 == r2).sum(axis=1)
    grid = np.linspace(0, 1, 65)
    best = lambda lo: np.max([log_likelihood(lo + g * (top - lo), u, *d) for g in grid], axis=0)
    return (top >= threshold - 1e-12) & (best(np.full(len(u), threshold)) >= best(np.zeros(len(u))) - EVIDENCE)


def meet(pairs: DataFrame, table: DataFrame, key: str, other: str) -> DataFrame:
    """pairs joined with table on `key`; a row of the table that very many pairs want is copied, and its pairs are dealt over the copies."""
    hot = measured(cut(pairs.groupBy(key).count().filter(F.col("count") > COPY).select(key, F.ceil(F.col("count") / COPY).cast("int").alias("copies"))))
    copies = F.coalesce("copies", F.lit(1))
    own = pairs.join(hot, key, "left").withColumn("copy", F.pmod(F.xxhash64(other), copies).cast("int")).drop("copies")
    return own.join(table.join(hot, key, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies"), [key, "copy"]).drop("copy")


def estimate(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose registers leave the threshold plausible."""
    r = reps.select("rep", "n_shingles", "registers")
    rows = (
        meet(pairs, r.toDF("a", "n1", "r1"), "a", "b").join(r.toDF("b", "n2", "r2"), "b")
        .filter(F.least("n1", "n2") >= F.greatest("n1", "n2") * F.lit(threshold - 1e-9))
        .select("a", "b", "n1", "n2", "r1", "r2")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n1, n2 = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
                r1, r2 = (np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u2").reshape(batch.num_rows, -1) for k in (4, 5))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(plausible(n1, n2, r1, r2, threshold)))

    return rows.mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on the full sets of their whole texts."""
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    texts = texts_of(cut(reps.select("rep", "doc_id", "text_hash").join(ids, "rep")), docs)
    rows = meet(pairs, texts.toDF("a", "t1"), "a", "b").join(texts.toDF("b", "t2"), "b").select("a", "b", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(shingle_sets(batch.column(2), shingle), shingle_sets(batch.column(3), shingle), strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def block_links(sets: list[np.ndarray], component: np.ndarray, percent: int) -> np.ndarray:
    """For each set the smallest index that links between different components connect it to. Intersections come from products of 0/1 matrices, a slice of the shingles at a time."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    uniq, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    column = np.cumsum(count > 1) - 1
    keep = count[at] > 1  # a shingle of one set is in no intersection
    owner, at = owner[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, (lo, lo + 4096))
        m = np.zeros((n, 4096), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    link = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (component[:, None] != component[None, :])
    link |= np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(link, label[None, :], n).min(axis=1)
        if (new == label).all():
            return label
        label = new


def settle(members: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that connect whatever is linked between different components within a cluster, for members(hub, rep, component, n_shingles).

    A cluster is cut into blocks of bounded content: those of its largest component, and those of all the rest. Two blocks are
    compared in one task, which returns at most a link for each of its members; blocks of the largest component aren't
    compared with each other. So no pair of different components is left out, none is written out unless it joins something,
    and the few that a large group leaves open are compared with its members, not all members with each other.
    """
    sizes = members.groupBy("hub", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    largest = F.max(F.struct("n", "component", "size")).alias("top")
    open_ = sizes.groupBy("hub").agg(largest, F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size")).filter("parts > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK_SETS, size / BLOCK_SHINGLES, F.lit(1))).cast("int")
    main, rest = blocks(F.col("top.n"), F.col("top.size")), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"))
    open_ = measured(cut(open_.select("hub", F.col("top.component").alias("top"), main.alias("main"), rest.alias("rest"))))
    own = members.join(open_, "hub").withColumn("inner", F.col("component") == F.col("top"))
    own = own.withColumn("own", F.when(F.col("inner"), F.pmod(F.xxhash64("rep"), "main")).otherwise(F.col("main") + F.pmod(F.xxhash64("rep"), "rest")).cast("int"))
    other = F.explode(F.sequence(F.when(F.col("inner"), F.col("main")).otherwise(0), F.col("main") + F.col("rest") - 1)).alias("other")
    dealt = own.select("hub", "rep", "component", "own", other).select("hub", "rep", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    ids = own.select("rep").distinct()
    texts = texts_of(cut(reps.select("rep", "doc_id", "text_hash").join(ids, "rep")), docs)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        rep = t["rep"].to_numpy()
        label = block_links(list(shingle_sets(t["text"], shingle)), t["component"].to_numpy(), percent)
        some = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": rep[label[some]], "b": rep[some]})

    return dealt.join(texts, "rep").groupBy("hub", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct word shingles
    (A-Z in lower case, words split at ASCII white space). component_id is the smallest doc_id reachable by links.

    Null, empty and blank texts have an empty set and stay alone. A text of fewer words is one shingle. Equal sets are
    folded before anything is paired, so that copies cost nothing. A repeated row gets the same result again; a doc_id with
    several texts gets a row for each, linked by that text alone. A row without doc_id belongs to the component of
    its text, which is null, and the row kept, only if nothing that it is linked with has an id. Other columns are ignored. An empty table gives an empty table.

    Candidates: within each band's bucket, every member is paired with the smallest one, its hub; pairs that the registers
    leave plausible are verified on the full sets and contracted to components. Then the members of all buckets of one hub
    are a cluster; where it still holds several components, these are compared in blocks (settle), so that no candidate of
    the bands is left out, however large a group of near copies is.
    """
    bounded(docs.sparkSession)
    threshold = percent / 100
    sk = cut(sketches(docs, shingle, threshold))
    # a set is known by a number of its own, as one doc_id may come with several texts
    first = F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    reps = sk.filter("n_shingles > 0").groupBy("h1", "h2").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    reps = cut(reps.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "first.*", "n_shingles", "registers"))
    width = 2 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(bands_for(threshold) - 1)))
    bands = reps.select("rep", "registers", band.alias("i")).select("rep", F.xxhash64(F.expr(f"substring(registers, {width} * i + 1, {width})"), "i").alias("bucket"))
    hubs = bands.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = cut(bands.join(hubs, "bucket").groupBy("hub", "rep").agg(F.max("n").alias("n")))
    stars = members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    links = cut(verify(cut(estimate(stars, reps, threshold)), reps, docs, shingle, percent))
    found = components(links)

    # a bucket of two was settled by its star
    wide = measured(cut(members.groupBy("hub").agg(F.max("n").alias("most")).filter("most > 2").select("hub")))
    rest = members.join(wide, "hub").join(found.withColumnRenamed("node", "rep"), "rep", "left").join(reps.select("rep", "n_shingles"), "rep")
    more = cut(settle(cut(rest.select("hub", "rep", F.coalesce("component", "rep").alias("component"), "n_shingles")), reps, docs, shingle, percent))
    if more.limit(1).count():
        found = components(links.unionByName(more))

    linked = reps.select("rep", "h1", "h2", "doc_id").join(found.withColumnRenamed("node", "rep"), "rep")
    least = measured(cut(linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))))
    of = linked.join(least, "component").select("h1", "h2", "component_id").unionByName(reps.join(found, F.col("rep") == F.col("node"), "left_anti").select("h1", "h2", F.col("doc_id").alias("component_id")))
    return (
        sk.drop("registers", "text_hash").join(of, ["h1", "h2"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
