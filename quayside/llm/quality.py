"""Quality of whole texts by Bradley-Terry ranking: scores learnt from pairs of a good and a bad text, with a threshold at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, hashed_words, text_blocks

#: The most labelled texts of each label that are used for fitting; comparisons in each step, steps, rate and weight decay.
PER_LABEL, PAIRS, STEPS, RATE, DECAY = 3000, 4096, 400, 0.5, 1e-3
#: The score that stands at the threshold.
AT_THRESHOLD = 0.3

_SYMBOLS = b"!*#%&$|?.,;:"
_KIND = np.zeros(256, np.int64)  # 0: other ASCII signs
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[32], _KIND[10], _KIND[13], _KIND[9] = 1, 2, 3, 4, 5, 6, 5, 5
for _k, _c in enumerate(_SYMBOLS):
    _KIND[_c] = 7 + _k
_KINDS = 7 + len(_SYMBOLS)


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of figures for each text: shares of kinds of characters, lengths of words and lines, repetition."""
    rows = len(off) - 1
    doc = np.repeat(np.arange(rows), np.diff(off))
    kinds = np.bincount(doc * _KINDS + _KIND[buf], minlength=rows * _KINDS).reshape(rows, _KINDS).astype(float)
    size = np.maximum(kinds.sum(axis=1), 1)
    words, at, starts, ends = hashed_words(buf, off)
    n = np.diff(at)
    length = np.concatenate([[0], np.cumsum(ends - starts)])
    mean = np.diff(length[at]) / np.maximum(n, 1)
    again = np.zeros(len(words) + 1)
    if len(words) > 1:
        again[2:] = np.cumsum(words[1:] == words[:-1])
    repeats = (again[at[1:]] - again[np.minimum(at[:-1] + 1, at[1:])]) / np.maximum(n, 1)
    distinct, top = np.zeros(rows), np.zeros(rows)
    for k in np.flatnonzero(n):
        _, c = np.unique(words[at[k] : at[k + 1]], return_counts=True)
        distinct[k], top[k] = len(c) / np.sqrt(n[k]), c.max() / n[k]
    lines = kinds[:, 6] + 1
    letters = kinds[:, 1] + kinds[:, 2] + kinds[:, 4]
    out = [np.log1p(size), np.log1p(n), mean, np.log1p(n / lines), distinct, np.log1p(distinct), top, repeats, kinds[:, 2] / np.maximum(letters, 1), letters / size, n == 0, n < 5, n < 20]
    out += [np.sqrt(kinds[:, k] / size) for k in range(_KINDS)]
    return np.stack(out, axis=1).astype(np.float64)


@dataclass
class Model:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    threshold: float = 0.0
    slope: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.threshold) + np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, n_bad: int, n_good: int) -> Model:
    """Logistic loss on differences of features over random pairs of a good and a bad text. n_bad and n_good are the labels' counts in all training rows: their share is the quantile."""
    if not n_bad or not n_good or not y.any() or y.all():
        return Model()
    order = np.lexsort((*x.T[:4], y))
    x, y = x[order], y[order]
    m = Model(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6))
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng, w = np.random.default_rng(3), np.zeros(z.shape[1])
    for step in range(STEPS):
        d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        w += RATE / (1 + 5 * step / STEPS) * (p @ d / PAIRS - DECAY * w)
    m.weights = w
    raw = z @ w
    # both labels count as in the whole training set, not as in the sample
    weight = np.where(y == 1, n_good / len(good), n_bad / len(bad))
    up = np.argsort(raw, kind="stable")
    share = np.cumsum(weight[up]) / weight.sum()
    k = int(np.searchsorted(share, n_bad / (n_bad + n_good)))
    m.threshold = float((raw[up[k]] + raw[up[min(k + 1, len(up) - 1)]]) / 2)
    base = np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
    loss = lambda a: (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (a * (raw - m.threshold) + base))).sum()
    m.slope = float(min(np.geomspace(0.05, 20, 81), key=loss))
    return m


def figures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, of 64-bit integers, and the features of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in text_blocks(batch.column(0)):
                x = features(buf, off)
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + k).slice(i, j - i) for k in range(len(keep))), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], [*keep, "x"])

    return docs.select("text", *(F.col(k).cast("long") for k in keep)).mapInArrow(run, ", ".join([*(f"`{k}` long" for k in keep), "x array<double>"]))


def train(docs: DataFrame, labels: DataFrame, rows: Column) -> Model:
    """A model from labels(doc_id, quality) of the documents where `rows` holds. Several labels of a document count by their majority; a tie, or a null, counts for nothing."""
    bounded(docs.sparkSession)
    voted = labels.filter(F.coalesce(rows, F.lit(False)) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.avg("quality").alias("vote")).filter("vote <> 0.5").select("doc_id", (F.col("vote") > 0.5).cast("long").alias("quality"))
    counts = {r[0]: r[1] for r in voted.groupBy("quality").count().collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    count = F.when(F.col("quality") == 1, counts.get(1, 0)).otherwise(counts.get(0, 0))
    sampled = voted.filter(share * count < PER_LABEL)  # about 2 * PER_LABEL ids
    table = figures(docs.select("doc_id", "text").join(F.broadcast(sampled), "doc_id"), "quality").toArrow()
    if not table.num_rows:
        return Model()
    return fit(np.array(table["x"].to_pylist()), table["quality"].to_numpy(), counts.get(0, 0), counts.get(1, 0))


def rank(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column `score` from 0 to 1 (higher: better) and `predicted`, 1 from the threshold on. Null and empty texts are scored as empty ones. Other columns pass through; columns called score or predicted are replaced."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            parts = [shared.value.scores(features(buf, off)) for _, _, buf, off in text_blocks(t)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= AT_THRESHOLD).cast("int"))
