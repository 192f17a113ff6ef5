"""Fitted models: sums against brute force, and held-out accuracy on text whose kind is known."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import hmm_lm, language_id, quality
from quayside.llm.common import crc_part

SYLLABLES = {"aa": ["tha", "ing", "ou", "er", "nd"], "bb": ["ción", "lo", "ez", "que", "rr"], "cc": ["sch", "ung", "keit", "ver", "zu"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, text(rng, rng.choice(list(SYLLABLES)), rng.randrange(5, 120)), None) for i in range(400)]
    out = [(i, t, next(k for k, s in SYLLABLES.items() if any(x in t for x in s))) for i, t, _ in out]
    return out + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "tha ing", None), (1004, "Ångström é", "aa"), (1005, "er " * 30_000, "aa")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, train string, score double").repartition(3)


def test_scores_and_counts(spark, rows):
    got = {r.doc_id: r for r in hmm_lm.score(frame(spark, rows), crc_part(F.col("doc_id"), 7) != 2, states=4, passes=4).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t, _ in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        r = got[i]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (i in set(train), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score)
    held = [got[i] for i in tokens if i not in set(train)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_words_that_are_not_broadcast_score_alike(spark, rows, monkeypatch):
    train = crc_part(F.col("doc_id"), 7) != 2
    few = frame(spark, rows[:60])
    monkeypatch.setattr(hmm_lm, "SYMBOLS", 5)
    want = {r.doc_id: (r.n_known, r.base_score, r.score) for r in hmm_lm.score(few, train, 2, 2).collect()}
    monkeypatch.setattr(hmm_lm, "COMMON", 12)
    for r in hmm_lm.score(few, train, 2, 2).collect():
        assert (r.n_known, r.base_score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1]))


def test_every_word_has_emissions_of_its_own_however_few_are_broadcast(spark, rows, monkeypatch):
    train = crc_part(F.col("doc_id"), 7) != 2
    few = frame(spark, rows[:60])
    want = {r.doc_id: r for r in hmm_lm.score(few, train, 3, 3).collect()}
    for most in (5, 0):
        monkeypatch.setattr(hmm_lm, "SYMBOLS", most)
        got = {r.doc_id: r for r in hmm_lm.score(few, train, 3, 3).collect()}
        assert {i: (r.train, r.n_tokens, r.n_known) for i, r in got.items()} == {i: (r.train, r.n_tokens, r.n_known) for i, r in want.items()}
        for i, r in got.items():
            assert (r.base_score, r.score) == (pytest.approx(want[i].base_score), pytest.approx(want[i].score, rel=1e-4))


def paths(m, x):
    """(states, probability) of every way through a text."""
    for z in itertools.product(range(len(m.start)), repeat=len(x)):
        p = m.start[z[0]] * m.emit[x[0], z[0]]
        for t in range(1, len(x)):
            p *= m.move[z[t - 1], z[t]] * m.emit[x[t], z[t]]
        yield z, p


def small_model(rng, states=3, symbols=5):
    return hmm_lm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T)


def test_forward_recursion_sums_over_all_paths():
    m = small_model(np.random.default_rng(0))
    texts = [np.array([0, 3, 1, 4, 2, 2]), np.array([2]), np.array([4, 4, 0])]
    for x, got in zip(texts, hmm_lm.log_likelihoods(texts, m), strict=True):
        assert got == pytest.approx(math.log(sum(p for _, p in paths(m, x))))


@pytest.mark.parametrize("segment", [2, 3, 2048])
def test_expected_counts_are_those_of_all_paths(monkeypatch, segment):
    monkeypatch.setattr(hmm_lm, "SEGMENT", segment)
    rng = np.random.default_rng(1)
    m = small_model(rng)
    texts = [rng.integers(0, 5, n) for n in (1, 5, 7, 2, 6)]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for x in texts:
        every = list(paths(m, x))
        total = sum(p for _, p in every)
        for z, p in every:
            start[z[0]] += p / total
            for t, k in enumerate(z):
                emit[x[t], k] += p / total
                if t:
                    move[z[t - 1], k] += p / total
    for got, want in zip(hmm_lm.expected_counts(iter(texts), m), (start, move, emit), strict=True):
        assert got == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_long_texts_lose_no_move():
    rng = np.random.default_rng(1)
    m = hmm_lm.first_model(rng.dirichlet(np.ones(9)), 3)
    texts = [rng.integers(0, 9, n) for n in (1, 5, 3000, 7000)]
    start, move, emit = hmm_lm.expected_counts(iter(texts), m)
    assert start.sum() == pytest.approx(4, rel=1e-4) and emit.sum() == pytest.approx(10006, rel=1e-4)
    assert move.sum() == pytest.approx(10002, rel=1e-4)
    assert emit.sum(axis=1) == pytest.approx(np.bincount(np.concatenate(texts), minlength=9), rel=1e-4)


def test_nothing_to_learn_from(spark, rows):
    few = frame(spark, rows[:5])
    assert all(math.isfinite(r.score) for r in hmm_lm.score(few, F.lit(False), 2, 1).collect())
    assert hmm_lm.score(few.limit(0), F.lit(True), 2, 1).collect() == []
    assert {r.lang_pred for r in language_id.identify(few, F.lit(False)).collect()} == {"und"}
    assert language_id.identify(few.limit(0), F.lit(True)).collect() == []


def test_languages_of_held_out_texts(spark, rows):
    got = {r.doc_id: r for r in language_id.identify(frame(spark, rows), crc_part(F.col("doc_id"), 5) != 0).collect()}
    held = [(i, lang) for i, _, lang in rows if i < 1000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and not got[1000].accepted and got[1000].score == 0
    assert got[1004].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows)


def test_every_language_is_learnt(spark):
    few = frame(spark, [(i, f"word{i} tha ing", f"l{i}") for i in range(230)])
    assert language_id.sample(few.select("doc_id", "lang", "text")).select("lang").distinct().count() == 230


def test_quality_of_held_out_texts(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(500):
        good = rng.random() < 0.8
        t = text(rng, "aa", rng.randrange(10, 80)) if good else rng.choice([lambda: text(rng, "aa", 20).upper() + "!!!", lambda: "buy now " * 30, lambda: "### $$$ %%% " * 9])()
        docs.append((i, t, 9.0))
        labels.append((i, int(good), 0))
    docs += [(900, None, 1.0), (901, "", 1.0), (902, "x" * 200_000, 1.0)]
    labels += [(3, None, 0), (4, labels[4][1], 0), (5, 1 - labels[5][1], 0), (900, 0, 0), (5000, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(df, lab, crc_part(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r for r in quality.rank(df, model).collect()}
    truth = {i: q for i, q, _ in labels if i < 500 and q is not None and i != 5}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    empty = quality.train(df, lab.limit(0), F.lit(True))
    assert {r.score for r in quality.rank(df, empty).collect()} == {0.5}
    assert quality.rank(df.limit(0), model).collect() == []


def test_nothing_learnt_is_nothing_accepted(spark):
    docs = spark.createDataFrame([(1, "some letters", None), (2, None, "en"), (3, "...", "en")], "doc_id long, text string, lang string")
    got = language_id.identify(docs, F.lit(False)).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score, r.accepted) for r in got) == [(1, "und", 0.0, False), (2, "und", 0.0, False), (3, "und", 0.0, False)]
