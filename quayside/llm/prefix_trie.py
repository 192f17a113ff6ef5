"""Prefix trie of conversations: ROLLUP over positional turn columns, block by block of a conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ordered

#: Turn columns of a block.
WIDTH = 8
#: Rows that one window sums; longer runs are summed in such stretches first.
STRETCH = 1024
#: Bytes of a piece of a list of ids.
PIECE = 1 << 16

WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, key: str, index: str, values: list[str]) -> DataFrame:
    """df with the sums of `values` over the rows of the same key and a smaller index in their place. A key's rows are summed in stretches of the index, so that one key may have most rows."""
    near = df.withColumn("_stretch", F.expr(f"{index} div {STRETCH}"))
    sums = near.groupBy(key, "_stretch").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    w = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    far = sums.select(key, "_stretch", *[F.coalesce(F.sum(f"_{v}").over(w), F.lit(0)).alias(f"_{v}") for v in values])
    w = Window.partitionBy(key, "_stretch").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumns({v: F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})
    return near.join(far, [key, "_stretch"]).select(*[(F.col(c) + F.col(f"_{c}")).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that stand for a role and a text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, words): the turns of conversations(conv_id, turn, role, text), numbered from 0 in the order of turn, null first, ties by turn_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", turn_id(role, text).alias("turn_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).alias("one"))
    placed = cut(ordered(rows, [F.col("conv_id"), F.col("turn"), F.col("turn_id")], "one"))
    first = placed.groupBy("conv_id").agg(F.min("before").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("before") - F.col("first")).alias("pos"), "turn_id", "words")


def rebuilt(own: DataFrame, share: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, turn_id, words) and (conv_id, length): every conversation c begins with the first h turns of conversation c - c % share, all if it has fewer, none if there is none, and goes on with its own turns after its first h; h = crc32(c) % most."""
    c = F.col("conv_id")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    bases = convs.filter(c % share == 0).select(c.alias("base"), F.col("n").alias("base_n"))
    h = F.crc32(c.cast("string").cast("binary")) % most
    info = convs.withColumns({"base": c - c % share, "h": h}).join(bases, "base", "left")
    info = info.withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    info = cut(info.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = own.filter((c % share == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    heads = heads.join(info.filter("m > 0"), "base").filter("pos < m").select("conv_id", "pos", "turn_id", "words")
    rest = own.join(info, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "turn_id", "words")
    return heads.unionByName(rest), info.select("conv_id", "length")


def lane(turn: Column, pos: Column, seed: int) -> Column:
    """A number for a turn at its place; a prefix is known by the sums of two such numbers over its turns."""
    return F.xxhash64(turn, pos.cast("long"), F.lit(seed)).cast("decimal(38,0)")


def turn_blocks(seqs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, block, last, a, b, t1 .. tWIDTH): WIDTH turns of a conversation as columns. a, b: the node at which the block begins, by the sums over all turns before it. last: whether the conversation ends in this block."""
    slot = F.col("pos") % WIDTH
    placed = seqs.select("conv_id", F.expr(f"pos div {WIDTH}").alias("block"), slot.alias("slot"), F.struct("turn_id", "words").alias("t"), lane(F.col("turn_id"), F.col("pos"), 1).alias("a"), lane(F.col("turn_id"), F.col("pos"), 2).alias("b"))
    none = lengths.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("slot"), F.lit(None).cast(placed.schema["t"].dataType).alias("t"), *[F.lit(0).cast("decimal(38,0)").alias(x) for x in "ab"])
    own = placed.unionByName(none).groupBy("conv_id", "block").agg(*[F.max(F.when(F.col("slot") == k, F.col("t"))).alias(f"t{k + 1}") for k in range(WIDTH)], F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"))
    own = cut(own.join(lengths, "conv_id").withColumns({"last": F.expr(f"block = greatest(length - 1, 0) div {WIDTH}"), "long": F.col("length") > WIDTH}).drop("length"))
    zero = {x: F.lit(0).cast("decimal(38,0)") for x in "ab"}
    return cut(own.filter("not long").withColumns(zero).unionByName(running(own.filter("long"), "conv_id", "block", ["a", "b"])).drop("long"))


def rolled(blocks: DataFrame, aggregates: str) -> DataFrame:
    """Each prefix of each block's turns: (block, a, b, t1 .. tWIDTH, d, aggregates); d: how many turns of the block it has."""
    names = ", ".join(f"t{k + 1}" for k in range(WIDTH))
    at_end = "element_at(array(" + names + "), greatest(d, 1))"
    out = blocks.sparkSession.sql(f"SELECT block, a, b, {names}, cast({WIDTH} - bit_count(grouping_id()) AS int) AS d, {aggregates} FROM {{blocks}} GROUP BY block, a, b, ROLLUP({names})", blocks=blocks)
    # beyond the end of a conversation there is no node; the node without turns of a block is the last one of the block before
    return out.withColumn("t", F.expr(at_end)).filter("if(d = 0, block = 0, t is not null)")


def pieces(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, first, piece): the members of each node in ends(conv_id, depth, member), ascending and joined by commas, in pieces. Rows are dealt by ranges, so that a node with most members lies in many tasks."""
    order = ["conv_id", "depth", "member"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size = None, [], 0
        done: list[tuple[int, int, int, str]] = []
        for batch in batches:
            for *now, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (now != node or size > PIECE):
                    done.append((*node, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                node, size = now, size + 8
                ids.append(member)
            if done:
                yield pa.RecordBatch.from_arrays([*map(pa.array, list(zip(*done, strict=True))[:3]), pa.array([x[3] for x in done], pa.string())], ["conv_id", "depth", "first", "piece"])
                done = []
        if ids:
            yield pa.RecordBatch.from_arrays([*([x] for x in (*node, ids[0])), [",".join(map(str, ids))]], ["conv_id", "depth", "first", "piece"])

    return ends.repartitionByRange(*order).sortWithinPartitions(*order).select(order).mapInArrow(run, "conv_id long, depth long, first long, piece string")


def list_hashes(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of each node's members in ends(conv_id, depth, member), ascending and joined by commas. A task reads one piece after another; it never holds a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        done: list[tuple[int, int, str]] = []
        for batch in batches:
            for *now, piece in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if now == node:
                    state.update(b",")
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = now, hashlib.sha256()
                state.update(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done, strict=True))), ["conv_id", "depth", "ends_sha256"])
                done = []
        if node:
            yield pa.RecordBatch.from_arrays([[node[0]], [node[1]], [state.hexdigest()]], ["conv_id", "depth", "ends_sha256"])

    parts = cut(pieces(ends)).repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return parts.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def trie(seqs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_id) for every distinct prefix of seqs(conv_id, pos, turn_id, words); lengths(conv_id, length) has every conversation.

    A node is known by its depth and its smallest member. So the nodes with the same smallest member c form one path from
    where c leaves its parent to c's end: a node's children are the next one on its path and the paths that begin at it.
    Sums over a subtree are sums over members: each member brings its whole path, the smallest one only the part from the
    node on.
    """
    blocks = turn_blocks(seqs, lengths)
    depth = F.col("block") * WIDTH + F.col("d")

    def key(x: str, upto: Column) -> Column:
        """One of the sums that a node is known by, over so many turns of the block."""
        parts = [F.when((F.lit(k) < upto) & F.col(f"t{k + 1}").isNotNull(), lane(F.col(f"t{k + 1}.turn_id"), F.col("block") * WIDTH + k, "ab".index(x) + 1)).otherwise(F.lit(0)) for k in range(WIDTH)]
        return sum(parts, F.col(x)).cast("decimal(38,0)")

    keyed = cut(rolled(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs").select(
        "conv_id", depth.alias("depth"), "n_convs", F.when(F.col("d") > 0, F.col("t.turn_id")).alias("turn_id"), F.when(F.col("d") > 0, F.col("t.words")).otherwise(0).alias("words"),
        *[key(x, F.col("d") - k).alias(x + "_up" * k) for x in "ab" for k in (0, 1)],
    ))
    paths = keyed.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min_by(F.struct("a_up", "b_up"), "depth").alias("up"))
    owner = keyed.select(F.col("a").alias("a_up"), F.col("b").alias("b_up"), (F.col("depth") + 1).alias("top"), F.col("conv_id").alias("up_id"))
    paths = cut(paths.select("conv_id", "top", "bottom", "up.*").join(owner, ["a_up", "b_up", "top"], "left").select("conv_id", "top", "bottom", "up_id"))
    begun = paths.filter("top > 0").groupBy(F.col("up_id").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.count("*").alias("begun"))
    nodes = keyed.join(begun, ["conv_id", "depth"], "left").join(paths, "conv_id")
    nodes = nodes.withColumns({
        "parent_conv_id": F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("up_id")),
        "n_children": (F.col("depth") < F.col("bottom")).cast("long") + F.coalesce("begun", F.lit(0)),
        "value": (F.col("n_convs") - 1) * F.col("words"),
    })
    nodes = cut(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "turn_id", "value"))

    own = nodes.groupBy("conv_id").agg(F.sum("value").alias("value"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    given = blocks.join(own, "conv_id", "left").withColumns({"value": F.coalesce("value", F.lit(0)), "leaf": F.coalesce("leaf", F.lit(0))})
    sums = rolled(given, "min(conv_id) AS conv_id, sum(leaf) AS n_leaves, sum(value) AS saved").select("conv_id", depth.alias("depth"), "n_leaves", "saved")
    before = running(nodes.select("conv_id", "depth", "value"), "conv_id", "depth", ["value"]).withColumnRenamed("value", "before")

    turn_count = sum([F.col(f"t{k + 1}").isNotNull().cast("long") for k in range(WIDTH)], F.col("block") * WIDTH)
    last = blocks.filter("last").select(F.col("conv_id").alias("member"), turn_count.alias("depth"), *[key(x, F.lit(WIDTH)).alias(x) for x in "ab"])
    ends = list_hashes(cut(last.join(keyed.select("a", "b", "depth", "conv_id"), ["a", "b", "depth"]).select("conv_id", "depth", "member")))
    out = nodes.join(sums, ["conv_id", "depth"]).join(before, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved") - F.col("before")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "turn_id",
    )


def conversation_trie(conversations: DataFrame, share: int = 20, most: int = 4) -> DataFrame:
    """trie() of the rebuilt conversations of conversations(conv_id, turn, role, text, ...).

    Turns are ordered by turn, null first; turns of one number come in the order of turn_id, which is a hash, and repeated
    rows are turns of their own. Null role or text is an empty one; an empty turn is a turn. Rows without conv_id belong to
    no conversation. A conversation of which no turn is left is a member of the root, which has depth 0, parent null and no
    turn_id. c - c % share has the sign rules of SQL's %. Texts are hashed whole where they are read and never shuffled.
    Other columns are ignored. An empty table gives an empty table, without a root.
    """
    return trie(*rebuilt(turns(conversations), share, most))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes with role and text of their last turn (root: null)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = conversations.select(turn_id(role, text).alias("turn_id"), role.alias("role"), text.alias("text")).dropDuplicates(["turn_id"])
    return nodes.join(known, "turn_id", "left")
