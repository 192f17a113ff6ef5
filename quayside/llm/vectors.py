"""Near-duplicate vectors by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, measured, mix
from .components import components

#: Half width of a window, in standard deviations of the difference of a pair at the threshold.
WINDOW = 2.0
#: Collisions that a pair at the threshold is expected to have, and the chance that it has too few.
EXPECTED, MISS = 16.0, 1e-5


def plan(n: int, least: float) -> tuple[int, int, int, float]:
    """(sign projections in a cell, groups of projections, collisions needed, half width) for n vectors and the smallest cosine.

    Along a random direction, two unit vectors differ by a normal variate with the length of their difference; their signs
    agree with the chance 1 - angle / pi. The more vectors there are, the more signs a cell has, so that cells stay small.
    """
    signs = max(2, math.ceil(math.log2(max(n, 2))) - 4)
    angle = math.acos(least)
    hit = (1 - angle / math.pi) ** signs * math.erf(WINDOW / math.sqrt(2))
    groups = math.ceil(EXPECTED / hit)
    need, below = 0, 0.0
    while below + (p := math.comb(groups, need) * hit**need * (1 - hit) ** (groups - need)) <= MISS:
        need, below = need + 1, below + p
    return signs, groups, max(1, need), WINDOW * math.sqrt(2 - 2 * least)


def read_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, h1, h2, vector): vector holds the direction as 64-bit floats; equal vectors, and only these, have equal h1 and h2. Null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, out = [], [], []
            for x in batch.column(1):
                v = None if not x.is_valid or x.values is None or x.values.null_count else x.values.to_numpy(zero_copy_only=False)
                top = np.abs(v).max() if v is not None and len(v) and np.isfinite(v).all() else 0.0
                if top > 0:
                    v = v / top  # so that squares neither vanish nor overflow
                    digest = blake2b(x.values.to_numpy(zero_copy_only=False).tobytes() + len(v).to_bytes(4, "little"), digest_size=16).digest()
                    h1.append(int.from_bytes(digest[:8], "little", signed=True))
                    h2.append(int.from_bytes(digest[8:], "little", signed=True))
                    out.append((v / np.linalg.norm(v)).tobytes())
                else:
                    h1.append(None), h2.append(None), out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "h1", "h2", "vector"])

    return table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, h1 long, h2 long, vector binary")


def projections(reps: DataFrame, signs: int, groups: int) -> DataFrame:
    """(rep, cell, x): for each vector and group of projections, a cell by the group's number, the vector's length and its signs, and the place along the group's sorted projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) for x in batch.column(1)], np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for i in range(0, len(rows), 1024):
                    part = pa.array(rows[i : i + 1024])
                    v = np.frombuffer(b"".join(batch.column(1).take(part).to_pylist())).reshape(len(part), -1)
                    rng = np.random.default_rng([29, int(size)])
                    code = np.zeros((len(part), groups), np.int64)
                    for _ in range(signs):
                        code = code * 2 + (v @ rng.standard_normal((v.shape[1], groups)) > 0)
                    x = v @ rng.standard_normal((v.shape[1], groups))
                    cell = mix(code.view(np.uint64) ^ np.uint64(int(size) << 40)).view(np.int64)
                    ids = np.repeat(batch.column(0).take(part).to_numpy(), groups)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cell.ravel()), pa.array(np.tile(np.arange(groups), len(part))), pa.array(x.ravel())], ["rep", "cell", "group", "x"])

    return reps.select("rep", "vector").mapInArrow(run, "rep long, cell long, group long, x double")


def collisions(projected: DataFrame, half: float, need: int) -> DataFrame:
    """(a, b) of the pairs that share a cell and lie within each other's window in `need` groups or more."""
    slot = F.floor(F.col("x") / half)
    lower = projected.select("group", "cell", slot.alias("slot"), F.col("rep").alias("a"), F.col("x").alias("xa"))
    # of two vectors in order of (x, id), the upper one is in the lower one's slot or the next
    upper = projected.select("group", "cell", F.explode(F.array(slot, slot - 1)).alias("slot"), F.col("rep").alias("b"), F.col("x").alias("xb"))
    met = lower.join(upper, ["group", "cell", "slot"]).filter((F.col("xb") - F.col("xa") <= half) & ((F.col("xb") > F.col("xa")) | ((F.col("xb") == F.col("xa")) & (F.col("b") > F.col("a")))))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.groupBy("a", "b").count().filter(F.col("count") >= need).select("a", "b")


def verify(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    r = reps.select("rep", "vector")
    rows = pairs.join(r.toDF("a", "va"), "a").join(r.toDF("b", "vb"), "b").select("a", "b", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.frombuffer(x.as_buffer()) @ np.frombuffer(y.as_buffer()) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(table: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every distinct pair of a vec_id and a vector of table(vec_id, embedding, ...).

    Vectors are linked if their cosine, in double precision, is `least` or more and their collisions pass the calibrated
    count, which a pair at the threshold fails with a chance of at most MISS, closer pairs more rarely. n_links counts
    the other vectors linked directly; component_id is the smallest vec_id reachable.

    Null, zero and empty vectors, and those with a null or non-finite component, link with nothing; so do vectors of
    different length. Equal vectors are folded before anything is paired, and still count as links of each other. A vec_id
    with several vectors gets a row for each, with that vector's links and component; rows without vec_id are never kept.
    Repeated rows count once. Other columns are ignored. An empty table gives an empty table.
    """
    v = cut(read_vectors(table))
    own = v.filter("vector is not null").select("vec_id", "h1", "h2").distinct()
    folded = own.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # a vector is known by a number of its own, as one vec_id may come with several
    vectors = cut(folded.join(v.dropDuplicates(["h1", "h2"]).select("h1", "h2", "vector"), ["h1", "h2"]).select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "least", "copies", "vector"))
    signs, groups, need, half = plan(vectors.count(), least)
    links = cut(verify(collisions(projections(vectors, signs, groups), half, need), vectors, least))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = vectors.select(F.col("rep").alias("b"), "copies")
    n = both.join(copies, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("n"))
    found = components(links).withColumnRenamed("node", "rep")
    named = vectors.select("rep", "least").join(found, "rep")
    ids = measured(cut(named.groupBy("component").agg(F.min("least").alias("component_id"))))
    of = vectors.select("h1", "h2", "rep", "least", "copies").join(n, "rep", "left").join(found.join(ids, "component").select("rep", "component_id"), "rep", "left")
    of = of.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = v.select("vec_id", "h1", "h2").distinct().join(of, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
