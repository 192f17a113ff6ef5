"""Language of whole texts: averaged embeddings of hashed subwords under a linear softmax, fitted by stochastic gradient descent, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, measured, text_blocks

UNDETERMINED = "und"
#: Subwords are runs of so many bytes; they share BUCKETS embeddings of SIZE numbers.
RUNS, BUCKETS, SIZE = (3, 4), 1 << 14, 16
#: The most labelled texts of a language that are used for fitting. Every language is learnt.
PER_LANGUAGE = 600
EPOCHS, RATE = 6, 2.0
#: Share of right answers among accepted ones that the rejection threshold must reach on the texts kept for calibration.
PRECISION = 0.99

# letters and bytes beyond ASCII stand for themselves (A-Z in lower case), all else for a blank
_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    table: np.ndarray | None = None  # what each bucket adds to each language's logit
    bias: np.ndarray | None = None
    temperature: float = 1.0
    least: float = 0.0  # scores below it are rejected


def subwords(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, buckets) of the runs of bytes that aren't all blanks."""
    c = _CLASS[buf]
    for n in RUNS:
        if len(c) < n:
            continue
        code = np.zeros(len(c) - n + 1, np.uint32)
        for k in range(n):
            code = code << np.uint32(8) | c[k : len(c) - n + 1 + k]
        at = np.flatnonzero(code != np.uint32(0x20202020 & (1 << 8 * n) - 1))
        h = (code[at] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        yield n, at, (h * np.uint32(0x85EBCA77) >> np.uint32(33 - BUCKETS.bit_length())).astype(np.int64)


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_ = np.concatenate([[0], np.cumsum((buf < 128) & (_CLASS[buf] != 32))])
    out = np.diff(ascii_[off]) > 0
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(map(str.isalpha, buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def bags(docs: DataFrame) -> DataFrame:
    """(lang, buckets, counts) of each text with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in text_blocks(batch.column(1)):
                letter = has_letter(buf, off)
                rows = [k for k in range(j - i) if letter[k]]
                found = [np.unique(np.concatenate([b for _, _, b in subwords(buf[off[k] : off[k + 1]])] or [np.zeros(0, np.int64)]), return_counts=True) for k in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i + k for k in rows], pa.int64())), pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))], ["lang", "buckets", "counts"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, buckets array<int>, counts array<int>")


def sample(labelled: DataFrame) -> DataFrame:
    """At most about PER_LANGUAGE rows of each language, chosen by a hash of doc_id."""
    sizes = cut(labelled.groupBy("lang").count())
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    return labelled.join(measured(sizes), "lang").filter(share * F.col("count") < PER_LANGUAGE).drop("count")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Stochastic gradient descent on four fifths of the rows; the rest set temperature and rejection threshold."""
    rows = sorted((r for r in rows if len(r[1])), key=lambda r: (r[0], len(r[1]), int(r[1].sum()), int(r[2].sum())))
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model()
    rng = np.random.default_rng(5)
    order = rng.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist()) if len(rows) >= 50 else set()
    train = [i for i in order.tolist() if i not in held]
    code = {x: k for k, x in enumerate(languages)}
    e, w, b = rng.standard_normal((BUCKETS, SIZE)) * 0.1, np.zeros((SIZE, len(languages))), np.zeros(len(languages))
    seen = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train).tolist():
            lang, idx, n = rows[i]
            x = n / n.sum()
            rate = RATE * (1 - seen / (EPOCHS * len(train)))
            seen += 1
            h = x @ e[idx]
            g = softmax(h @ w + b)
            g[code[lang]] -= 1
            back = w @ g
            w -= rate * np.outer(h, g)
            b -= rate * 0.1 * g
            e[idx] -= rate * np.outer(x, back) * 10  # a text's mean spreads a step over all its subwords
    table = e @ w
    m = Model(languages, table.astype(np.float32), b.astype(np.float32))
    some = sorted(held) or train
    logits = np.array([(rows[i][2] / rows[i][2].sum()) @ table[rows[i][1]] + b for i in some])
    truth = np.array([code[rows[i][0]] for i in some])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(some)), truth], 1e-12)).mean()
    m.temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    p = softmax(logits / m.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    down = np.argsort(-score, kind="stable")
    good = np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= PRECISION
    m.least = float(score[down][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return m


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, ...) with lang_pred, score and accepted; the texts decide alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.languages, UNDETERMINED])
        for batch in batches:
            for i, j, buf, off in text_blocks(batch.column(1)):
                letter = has_letter(buf, off)
                logits, n = np.zeros((j - i, len(m.languages))), np.zeros(j - i)
                for width, at, bucket in subwords(buf):
                    row = np.searchsorted(off, at, side="right") - 1
                    inner = at + width <= off[row + 1]  # not across two texts
                    at, bucket, row = at[inner], bucket[inner], row[inner]
                    some, first, count = np.unique(row, return_index=True, return_counts=True) if len(row) else (row, row, row)
                    if len(some) and m.languages:
                        logits[some] += np.add.reduceat(m.table[bucket], first, axis=0)
                    n[some] += count
                if m.languages:
                    p = softmax((logits / np.maximum(n, 1)[:, None] + m.bias) / m.temperature)
                    best, score = np.where(letter, p.argmax(axis=1), len(m.languages)), np.where(letter, p.max(axis=1), 0.0)
                else:
                    best, score = np.zeros(j - i, np.int64), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), names.take(pa.array(best)), pa.array(score), pa.array((score >= m.least) & letter & bool(m.languages))], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, train: Column) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row of docs(doc_id, text, lang, ...), learnt from rows where `train` holds and text and lang aren't null.

    score is the calibrated probability of lang_pred; accepted is false where it lies below the threshold that gives
    PRECISION on texts kept for calibration. A null text, or one without any letter, is `und` with score 0 and isn't
    accepted; so is every text if nothing can be learnt. Fitting uses at most about PER_LANGUAGE texts of each language,
    whole ones; predictions read every whole text. Repeated rows are predicted each. Other columns are ignored. An empty
    table gives an empty table.
    """
    bounded(docs.sparkSession)
    rows = bags(sample(docs.filter(F.coalesce(train, F.lit(False)) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text"))).toArrow()
    lists = zip(rows["lang"].to_pylist(), rows["buckets"], rows["counts"], strict=True)
    model = fit([(lang, b.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(np.float64)) for lang, b, n in lists])
    return predict(docs, model)
