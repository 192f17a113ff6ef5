"""Document likelihoods under a hidden Markov language model: Baum-Welch counts summed over partitions, exact scores by the scaled forward recursion."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, bounded, cut, discard, forget, hashed_words, mix, pack, placed, stash, text_blocks, unpack

#: Hidden states, passes of Baum-Welch, and the most words whose emission probabilities are broadcast; those of all others are joined.
STATES, PASSES, SYMBOLS = 8, 6, 1 << 19
#: The most words whose counts are broadcast, and so the most words broadcast at all.
COMMON = 1 << 20
#: Tokens of a long text that are gone through side by side with its other parts, sequences that are scored at once, and tokens in one matrix.
SEGMENT, WIDTH, CELLS = 4096, 2048, 1 << 18
#: Broadcast words whose sums travel in one row.
ROWS = 4096
#: Weight, in tokens, of the corpus's word frequencies in each state's emissions, and of an even choice in its transitions.
SMOOTH_WORDS, SMOOTH_STATES = 20.0, 1.0


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of each word, known by its 64-bit hash, in all whole texts; summed within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            uniq, at = np.unique(keys, return_inverse=True)
            return uniq, np.bincount(at, weights=n).astype(np.int64)

        for batch in batches:
            for _, _, buf, off in text_blocks(batch.column(0)):
                uniq, n = np.unique(hashed_words(buf, off)[0], return_counts=True)
                held.append((uniq, n))
                rows += len(uniq)
                if rows > 1 << 20:
                    held = [summed()]
                    rows = len(held[0][0])
                    if rows > 1 << 19:
                        yield table(*held[0])
                        held, rows = [], 0
        if held:
            yield table(*summed())

    def table(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, whole classes of like frequency, not more than `most`."""
    level = F.floor(F.log2("n") * 16).cast("int")
    rows, least = 0, 1 << 30
    for lv, n in sorted(map(tuple, counts.groupBy(level).count().collect()), reverse=True):
        rows += n
        if rows > most:
            break
        least = lv
    return counts.filter(level >= least)


def coded_texts(docs: DataFrame, train: Column, keys: np.ndarray, counts: np.ndarray, total: float) -> DataFrame:
    """A row for each document: symbols of its tokens, sums over the broadcast words, and all other words in order.

    Symbols are places among the keys, then one for a word never seen, one for the end, and one for each of the other words.
    """
    table = docs.sparkSession.sparkContext.broadcast((keys, counts))
    symbols = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = table.value
        base = np.log10((counts + 1) / total)
        order = np.argsort(keys)
        index = HashIndex(keys[order])
        for batch in batches:
            for i, j, buf, off in text_blocks(batch.column(2)):
                words, at, _, _ = hashed_words(buf, off)
                k = index.find(words)
                k[k >= 0] = order[k[k >= 0]]
                sums = np.diff(np.concatenate([[0.0], np.cumsum(np.where(k >= 0, base[k], 0.0) if len(base) else np.zeros(len(k)))])[at])
                sym = np.where(k < 0, symbols + 2, k).astype(np.uint32)
                n = np.diff(at)
                own = [np.append(sym[at[d] : at[d + 1]], np.uint32(symbols + 1)) for d in range(j - i)]
                lost = [words[at[d] : at[d + 1]][k[at[d] : at[d + 1]] < 0].view(np.int64) for d in range(j - i)]
                known = np.diff(np.concatenate([[0], np.cumsum(k >= 0)])[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(sums), pa.array([pack(x) for x in own], pa.binary()), pa.array(lost, pa.list_(pa.int64()))],
                    ["doc_id", "train", "n_tokens", "n_known", "base", "symbols", "words"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(train, F.lit(False)).alias("train"), "text")
    coded = rows.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base double, symbols binary, words array<long>")
    return coded.withColumn("row", F.monotonically_increasing_id())


def side_by_side(sizes: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """For sequences of falling length that run side by side: how many have a token at each step, where each step's tokens begin when they lie step by step, and where each of these tokens lies when the sequences follow one another."""
    steps = np.arange(int(sizes[0]) if len(sizes) else 0)
    n = np.searchsorted(-sizes, -steps, side="left")
    off = np.cumsum(n) - n
    seq = np.arange(int(n.sum())) - np.repeat(off, n)
    return n.tolist(), off.tolist(), (np.cumsum(sizes) - sizes)[seq] + np.repeat(steps, n)


def transfers(segs: list[np.ndarray], first: np.ndarray, m: Model) -> np.ndarray:
    """For each segment the product of its steps as a matrix, up to a factor: what takes the state weights before it to those at its end. A text's first segment begins with its own first token."""
    states = m.emit.shape[1]
    out = np.tile(np.eye(states), (len(segs), 1, 1))
    order = np.argsort([-len(x) for x in segs], kind="stable")
    n, off, place = side_by_side(np.array([len(segs[i]) for i in order], np.int64))
    if not n:
        return out
    obs = np.concatenate([segs[i] for i in order])[place]
    e = np.ascontiguousarray((m.emit / m.emit.max(axis=1, keepdims=True)).T)
    move = np.ascontiguousarray(m.move.T)
    # now[j, i, k]: from state i before to state j now, of sequence k; a finished one keeps its place at the end
    now = np.ascontiguousarray(np.broadcast_to(np.eye(states)[:, :, None], (states, states, len(segs))))
    for t, k in enumerate(n):
        if k < now.shape[2]:
            out[order[k : now.shape[2]]] = now[:, :, k:].transpose(2, 1, 0)
            now = np.ascontiguousarray(now[:, :, :k])
        step = (move @ now.reshape(states, -1)).reshape(states, states, k)
        if t == 0:
            step[:, :, first[order]] = np.eye(states)[:, :, None]
        now = np.multiply(step, e.take(obs[off[t] : off[t] + k], axis=1)[:, None], out=step)
        if t % 8 == 7:  # double precision has room for the steps between
            now /= now.sum(axis=(0, 1))
    out[order[: now.shape[2]]] = now.transpose(2, 1, 0)
    return out / out.sum(axis=(1, 2), keepdims=True)


def boundaries(texts: list[np.ndarray], m: Model) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(segment, weights behind it, weights before it) of all segments of the texts. The weights before one are the exact forward probabilities at the end of the segment before, those behind one the backward ones, up to a factor."""
    s = m.emit.shape[1]
    cuts = [[x[i : i + SEGMENT] for i in range(0, len(x), SEGMENT)] for x in texts]
    long = [k for k, c in enumerate(cuts) if len(c) > 1]
    segs = [g for k in long for g in cuts[k]]
    starts = np.cumsum([0, *(len(cuts[k]) for k in long)])
    first = np.zeros(len(segs), bool)
    first[starts[:-1]] = True
    r = transfers(segs, first, m)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = [(c[0], np.ones(s), None) for c in cuts if len(c) == 1]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        before: list[np.ndarray | None] = [None]
        now = m.start
        for k in range(a, b - 1):
            now = now @ r[k]
            now = now / now.sum()
            before.append(now)
        behind = [np.ones(s)]
        for k in range(b - 1, a, -1):
            ahead = r[k] @ behind[-1]
            behind.append(ahead / ahead.sum())
        out += zip(segs[a:b], behind[::-1], before, strict=True)
    return out


def expected_counts(texts: Iterator[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the whole texts of expected starts, moves and emissions: one pass of the forward-backward algorithm.

    Long texts are gone through in segments side by side, with the exact probabilities at their limits, so that every move
    counts, that from one segment to the next too.
    """
    s, symbols = m.emit.shape[1], m.emit.shape[0]
    start, move, emit = np.zeros(s), np.zeros((s, s)), np.zeros((symbols, s))
    segs = sorted(boundaries(list(texts), m), key=lambda y: -len(y[0]))
    a, one = m.move.astype(np.float32), np.ones(s, np.float32)
    back = np.ascontiguousarray(a.T)
    e = (m.emit / m.emit.max(axis=1, keepdims=True)).astype(np.float32)  # a word's factor cancels out
    ends = np.cumsum([len(x) for x, _, _ in segs])
    g = 0
    while g < len(segs):
        begin = g
        g = max(g + 1, int(np.searchsorted(ends, (ends[g - 1] if g else 0) + CELLS, side="right")))
        part = segs[begin:g]
        sizes = np.array([len(x) for x, _, _ in part])
        n, off, place = side_by_side(sizes)
        obs = np.concatenate([x for x, _, _ in part])[place]
        inner = np.array([before is not None for _, _, before in part])
        entry = np.stack([m.start if before is None else before for _, _, before in part]).astype(np.float32)
        ahead = e.take(obs, axis=0)  # emissions, then what each token and the rest of its text weigh in each state
        alpha, beta, scale = np.empty_like(ahead), np.empty_like(ahead), np.empty(len(obs), np.float32)
        np.multiply(np.where(inner[:, None], entry @ a, entry), ahead[: n[0]], out=alpha[: n[0]])
        for t, k in enumerate(n):
            at = off[t]
            now, c = alpha[at : at + k], scale[at : at + k]
            if t:
                np.matmul(alpha[off[t - 1] : off[t - 1] + k], a, out=now)
                now *= ahead[at : at + k]
            np.matmul(now, one, out=c)
            now /= c[:, None]
        ahead /= scale[:, None]
        last = np.array(off)[sizes - 1] + np.arange(len(part))
        behind = np.stack([x for _, x, _ in part]).astype(np.float32)
        beta[last] = behind / (alpha[last] * behind).sum(axis=1, keepdims=True)
        for t in range(len(n) - 1, 0, -1):
            k, at = n[t], off[t]
            x = ahead[at : at + k]
            x *= beta[at : at + k]
            np.matmul(x, back, out=beta[off[t - 1] : off[t - 1] + k])
        ahead[: n[0]] *= beta[: n[0]]
        move += alpha.take(np.arange(n[0], len(obs)) - np.repeat(n[:-1], n[1:]), axis=0).T @ ahead[n[0] :]
        move += entry[inner].T @ ahead[: n[0]][inner]
        alpha *= beta
        start += alpha[: n[0]][~inner].sum(axis=0)
        for i, x in enumerate(np.ascontiguousarray(alpha.T)):
            emit[:, i] += np.bincount(obs, weights=x, minlength=symbols)
    return start, move * m.move, emit


def log_likelihoods(texts: list[np.ndarray], m: Model) -> np.ndarray:
    """Natural log-likelihood of each whole text by the scaled forward recursion. Texts run side by side, none is cut."""
    out = np.zeros(len(texts))
    order = np.argsort([-len(x) for x in texts], kind="stable")
    e, move = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    for g in range(0, len(order), WIDTH):
        part = order[g : g + WIDTH]
        sizes = np.array([len(texts[i]) for i in part])
        n, off, place = side_by_side(sizes)
        obs = np.concatenate([texts[i] for i in part])[place]
        scale, now = np.empty(len(obs)), None
        for t, k in enumerate(n):
            at = off[t]
            weights = e.take(obs[at : at + k], axis=1)
            weights *= m.start[:, None] if t == 0 else move @ now[:, :k]
            now = np.divide(weights, np.add.reduce(weights, axis=0, out=scale[at : at + k]), out=weights)
        total, logs = np.zeros(len(part)), np.log(scale)
        for t, k in enumerate(n):
            total[:k] += logs[off[t] : off[t] + k]
        out[part] = total
    return out


def disturbance(words: np.ndarray, states: int) -> np.ndarray:
    """A fixed positive factor for each word and state, which depends on the word's hash alone."""
    u = [np.stack([mix(words + np.uint64(((2 * i + half) * 0x9E3779B97F4A7C15 + 7) % 2**64)) for i in range(states)], axis=1) / 2.0**64 for half in (1, 2)]
    return np.exp(0.5 * np.sqrt(-2 * np.log(np.maximum(u[0], 2.0**-64))) * np.cos(2 * np.pi * u[1]))


def first_model(freq: np.ndarray, states: int, words: np.ndarray | None = None, more: np.ndarray | float = 0.0) -> Model:
    """Word frequencies with a fixed disturbance for each state, and states that tend to stay. `more` is what words outside freq add to each state's sum."""
    emit = freq[:, None] * disturbance(np.arange(len(freq), dtype=np.uint64) if words is None else words, states)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    even = np.full(states, 1 / states)
    return Model(even, move, emit / (emit.sum(axis=0) + more))


def groups_of(words: pa.Array, local: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words that one text alone has, over a batch: rows, places among the row's other words, and which distinct word each is, with the counts of these in order of row and word."""
    found = local.flatten()
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = local.value_parent_indices().to_numpy().astype(np.int64)
    k, n = found.field("k").to_numpy().astype(np.int64), found.field("n").to_numpy()
    starts = np.cumsum([0, *words.value_lengths().fill_null(0).to_numpy()])
    key = words.flatten().to_numpy()[starts[row] + k]
    order = np.lexsort((key, row))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(row[order]) != 0) | (np.diff(key[order]) != 0)
    return row[order], k[order], np.cumsum(new) - 1, n[order][new]


@dataclass
class Batch:
    """Texts over the words that occur in a batch, the model over these, and which rows of its emissions are whose."""

    texts: list[np.ndarray]
    model: Model
    uniq: np.ndarray  # the model's symbols
    shared: np.ndarray  # rows of the joined words, in order
    local: np.ndarray  # rows of the words of one text alone, in order
    group: np.ndarray  # which of these is the same word
    counts: np.ndarray  # occurrences of each such word


def own_symbols(batch: pa.RecordBatch, m: Model, scale: np.ndarray, total: float) -> Batch:
    """A batch (row, n_tokens, symbols, own, words, local, state) made ready: words of one text alone have the weights of `state`, or before the first pass their first ones."""
    symbols, states = m.emit.shape
    col = {x: batch.column(k) for k, x in enumerate(batch.schema.names)}
    texts = [unpack(x) for x in col["symbols"].to_pylist()]
    flat = np.concatenate(texts)
    at = np.cumsum([len(x) for x in texts])
    other = flat == symbols
    before = np.concatenate([[0], np.cumsum(other)])
    start = before[np.concatenate([[0], at[:-1]])]
    number = np.zeros(symbols + 1, np.int64)
    number[flat] = 1
    uniq = np.flatnonzero(number[:symbols])
    number[uniq] = np.arange(len(uniq))
    flat = number[flat]
    flat[other] = len(uniq) + np.arange(before[-1])
    emit = np.empty((len(uniq) + before[-1], states))
    emit[: len(uniq)], emit[len(uniq) :] = m.emit[uniq], m.emit[symbols - 2]
    own = col["own"]
    found = own.flatten()
    shared = np.zeros(0, np.int64)
    if len(found):
        shared = len(uniq) + start[own.value_parent_indices().to_numpy()] + found.field("k").to_numpy()
        emit[shared] = found.field("e").flatten().to_numpy().astype(np.float64).reshape(-1, states) / scale
    row, k, group, counts = groups_of(col["words"], col["local"])
    local = len(uniq) + start[row] + k
    if len(local):
        if col["state"].null_count == len(batch):
            first = np.searchsorted(group, np.arange(len(counts)))
            key = col["words"].flatten().to_numpy()[np.cumsum([0, *col["words"].value_lengths().fill_null(0).to_numpy()])[row[first]] + k[first]]
            weights = ((counts + 1) / total)[:, None] * disturbance(key.view(np.uint64), states)
        else:
            weights = col["state"].flatten().to_numpy().astype(np.float64).reshape(-1, states)
        emit[local] = weights[group] / scale
    return Batch(np.split(flat, at[:-1]), Model(m.start, m.move, emit), uniq, shared, local, group, counts)


BATCH = ("row", "n_tokens", "symbols", "own", "words", "local", "state")


def with_own(coded: DataFrame, need: DataFrame | None, table: DataFrame | None, state: DataFrame | None) -> DataFrame:
    """coded with `own`, the places and emission weights of the words that aren't broadcast and that several texts have, and `state`, the weights of those that one text alone has."""
    parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if need is None:
        out = coded.withColumn("own", F.lit(None).cast("array<struct<k:int,word:long,e:array<float>>>"))
    else:
        hits = need.join(table.hint("merge"), "word").select("row", "k", "word", "e")
        own = hits.repartition(parts, "row").groupBy("row").agg(F.collect_list(F.struct("k", "word", "e")).alias("own"))
        out = coded.join(own.hint("merge"), "row", "left")
    if state is None:
        return out.withColumn("state", F.lit(None).cast("array<float>"))
    return out.join(state.repartition(parts, "row").hint("merge"), "row", "left")


@dataclass
class Fitted:
    model: Model
    scale: np.ndarray  # each state's sum of weights
    table: DataFrame | None  # (word, e): weights of the words that aren't broadcast and that several texts have
    state: DataFrame | None  # (row, state): weights of those that one text alone has


def fit(coded: DataFrame, need: DataFrame | None, rest: DataFrame, shared: DataFrame | None, freq: np.ndarray, keys: np.ndarray, total: float, states: int, passes: int) -> Fitted:
    """Baum-Welch over all training rows of coded. Each pass sums expected counts within tasks, then by word. The driver gets those of the broadcast words.

    rest(word, n) are all other words, shared those of them that several texts have: their counts stay a table. A word of one
    text alone stays with its text, which is the only one that its counts come from and go to.
    """
    spark = coded.sparkSession
    cols = [f"s{i}" for i in range(states)]
    sums_of = lambda df: np.array([x or 0.0 for x in df.agg(*(F.sum(c) for c in cols)).first()])
    weights = lambda df: df.select("word", F.array(*(F.col(c).cast("float") for c in cols)).alias("e"))
    train = coded.filter("train")
    wanted = need.filter("train") if need is not None else None
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = (c.to_numpy() for c in batch.columns)
            e = ((n + 1) / total)[:, None] * disturbance(word.view(np.uint64), states)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(e[:, i]) for i in range(states))], ["word", "n", *cols])

    first = lambda df: df.mapInArrow(begin, "word long, n long, " + ", ".join(f"{c} double" for c in cols))
    words = np.concatenate([keys, np.array([1, 2], np.uint64)])
    more, table, state, rest_freq = np.zeros(states), None, None, 0.0
    if need is not None:
        rows, n = rest.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        rest_freq = (rows + n) / total
        table, more = weights(first(shared)), sums_of(first(rest))
    m = first_model(freq, states, words, more)
    scale = (freq[:, None] * disturbance(words, states)).sum(axis=0) + more
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = x.values.to_numpy().astype(np.float64)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["word", "e"])

    last: list[DataFrame] = []
    for _ in range(passes):
        model = spark.sparkContext.broadcast((m, scale))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            m, scale = model.value
            start, move, emit, alone = np.zeros(states), np.zeros((states, states)), np.zeros(m.emit.shape), np.zeros(states)
            for batch in batches:
                if not batch.num_rows:
                    continue
                b = own_symbols(batch, m, scale, total)
                s, v, e = expected_counts(iter(b.texts), b.model)
                start, move = start + s, move + v
                emit[b.uniq] += e[: len(b.uniq)]
                if len(b.shared):
                    yield rows_of(batch.column(3).flatten().field("word"), "shared", e[b.shared])
                if len(b.local):
                    own = np.add.reduceat(e[b.local], np.searchsorted(b.group, np.arange(len(b.counts))), axis=0)
                    alone += own.sum(axis=0)
                    size = np.zeros(batch.num_rows + 1, np.int64)
                    row = batch.column(5).value_parent_indices().to_numpy()
                    np.add.at(size, 1 + np.sort(row)[np.searchsorted(b.group, np.arange(len(b.counts)))], states)
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), pa.array((own + SMOOTH_WORDS * (b.counts + 1)[:, None] / total).ravel(), pa.float32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["row"] * batch.num_rows), lists], ["word", "kind", "e"])
            every = np.vstack([start[None], move, emit, alone[None]])
            every = np.vstack([every, np.zeros((-len(every) % ROWS, states))]).reshape(-1, ROWS * states)
            some = np.flatnonzero(every.any(axis=1))
            for k in some.tolist():
                yield rows_of(pa.array([k]), "head", every[k : k + 1])

        def rows_of(word: pa.Array, kind: str, e: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1, dtype=np.int32) * e.shape[1], pa.int32()), pa.array(e.ravel(), pa.float32()))
            return pa.RecordBatch.from_arrays([word, pa.array([kind] * len(e)), lists], ["word", "kind", "e"])

        rows = with_own(train, wanted, table, state).select(*BATCH)
        result = stash(rows.mapInArrow(run, "word long, kind string, e array<float>"))
        got = result.filter("kind = 'head'").select("word", "e").repartition(parts, "word").mapInArrow(add_up, "word long, e binary").toArrow()
        every = np.zeros((2 + states + len(freq), states))
        for k, x in zip(got["word"].to_pylist(), got["e"].to_pylist(), strict=True):
            block = every[k * ROWS : (k + 1) * ROWS]
            block += np.frombuffer(x).reshape(-1, states)[: len(block)]
        tables = []
        more = every[-1]
        if need is not None:
            others = result.filter("kind = 'shared'").groupBy("word").agg(*(F.sum(F.col("e")[i].cast("double")).alias(c) for i, c in enumerate(cols)))
            grown = stash(shared.join(others.hint("merge"), "word").select("word", *((F.col(c) + SMOOTH_WORDS * (F.col("n") + 1) / total).cast("float").alias(c) for c in cols)))
            tables.append(grown)
            of = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            more = more + sums_of(grown) - SMOOTH_WORDS * sum(of) / total
            state = stash(result.filter("kind = 'row'").select(F.col("word").alias("row"), F.col("e").alias("state")))
            table = weights(grown)
            tables.append(state)
        start, move, emit = every[0] + SMOOTH_STATES, every[1 : 1 + states] + SMOOTH_STATES / states, every[1 + states : -1]
        emit = emit + SMOOTH_WORDS * freq[:, None]
        scale = emit.sum(axis=0) + more + SMOOTH_WORDS * rest_freq
        m = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / scale)
        model.destroy()
        for df in (result, *last):
            discard(df)
        last = tables
        del rows, got, every
        forget(spark)
    return Fitted(m, scale, table, state)


def by_text(coded: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """coded with `local` (place, count) of the words that one training text alone has and `shared` (place, word, count) of those that several texts have, and rest(word, n) of the latter."""
    need = coded.select("row", "train", F.posexplode("words").alias("k", "word"))
    parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = need.groupBy("word").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    known = cut(rest.join(of, "word").select("word", "n", (F.col("lo") == F.col("hi")).alias("alone")))
    hits = need.join(known.hint("merge"), "word").repartition(parts, "row").groupBy("row")
    lists = hits.agg(F.collect_list(F.when(F.col("alone"), F.struct("k", "n"))).alias("local"), F.collect_list(F.when(~F.col("alone"), F.struct("k", "word", "n"))).alias("shared"))
    return placed(coded.join(lists, "row", "left"), "row"), known.filter("not alone").select("word", "n")


def score(docs: DataFrame, train: Column, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text, ...).

    Tokens are words (A-Z in lower case, split at ASCII white space) and one end. base_score sums log10((c+1)/(N+V+1))
    with c, N, V over the rows where `train` holds. score is log10 of the text's probability: states move and emit a word of
    those rows, the end, or one unknown word, each with probabilities of its own in every state, so that both scores share
    their sample space. Training and scores take whole texts.

    Null and empty texts are one end token. A null `train` counts as false. Without training rows every probability is even.
    Repeated rows are scored, and counted, each time. Other columns are ignored. An empty table gives an empty table.
    """
    bounded(docs.sparkSession)
    own = docs.filter(F.coalesce(train, F.lit(False)))
    counts = stash(word_counts(own))
    n_words, v_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = own.count()
    n_all, v_all = n_words + ends, v_words + (ends > 0)
    common = frequent(counts, min(SYMBOLS, COMMON)).toArrow()
    keys, seen = common["word"].to_numpy().view(np.uint64), common["n"].to_numpy().astype(np.float64)
    order = np.lexsort((keys, -seen))
    keys, seen = keys[order], seen[order]
    total = float(n_all + v_all + 1)
    freq = np.concatenate([seen + 1, [1, ends + 1]])
    mass = float(n_words + v_words + 1 + ends + 1)
    coded = stash(coded_texts(docs, train, keys, seen, total))
    need, rest, shared = None, counts, None
    if v_words <= len(keys):
        none = F.lit(None)
        coded = coded.withColumns({"local": none.cast("array<struct<k:int,n:long>>"), "shared": none.cast("array<struct<k:int,word:long,n:long>>")})
    else:
        least = int(seen[-1]) if len(seen) else None
        rest = counts if least is None else counts.filter(F.col("n") < least)
        first = coded
        coded, shared = by_text(first, rest)
        discard(first)
        need = coded.select("row", "train", F.inline("shared"))
    forget(docs.sparkSession)
    fitted = fit(coded, need, rest, shared, freq / mass, keys, mass, states, passes)
    model = docs.sparkSession.sparkContext.broadcast((fitted.model, fitted.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, scale = model.value
        for batch in batches:
            if batch.num_rows:
                b = own_symbols(batch.select(list(BATCH)), m, scale, mass)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(log_likelihoods(b.texts, b.model) / math.log(10))], [*names, "hmm"])

    # words that weren't broadcast count by their lists
    logs = lambda c: F.coalesce(F.aggregate(c, F.lit(0.0), lambda x, w: x + F.log10(w["n"] + 1)), F.lit(0.0))
    more = F.coalesce(F.size("local"), F.lit(0)) + F.coalesce(F.size("shared"), F.lit(0))
    base = coded.withColumns({"n_lost": F.size("words").cast("long"), "log_c": logs("local") + logs("shared"), "more_known": F.greatest(more, F.lit(0)).cast("long")})
    names = ["doc_id", "train", "n_tokens", "n_known", "base", "n_lost", "log_c", "more_known"]
    every = with_own(base, need, fitted.table, fitted.state)
    out = every.select(*names, *(x for x in BATCH if x not in names)).mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base double, n_lost long, log_c double, more_known long, hmm double")
    end = math.log10((ends + 1) / total)
    return out.select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + F.col("more_known") + int(ends > 0)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + end + F.col("log_c") - F.col("n_lost") * math.log10(total)).alias("base_score"),
        F.col("hmm").alias("score"),
    )
