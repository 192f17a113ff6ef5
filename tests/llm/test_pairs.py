"""Near duplicates of texts and vectors against brute force, with the cases that tables bring along."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from quayside.llm import minhash, vectors
from quayside.llm.components import components

DOCS = "doc_id long, text string, lang string, rep long, hub long, h1 string"


def closure(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [None, "", "   \n", "One", "one", "a b", "A  B", "ünï çode wörds hëre and mOre", " ".join(base)]
    for _ in range(60):  # near copies of one text, around the threshold
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) for _ in range(60)]
    texts += [texts[20]] * 30 + ["long " + "x" * 300_000 + " text"] * 2
    rows = [(i * 3, t, "en", 1, 1, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    for k, percent in ((3, 85), (5, 80)):
        sets = {r[0]: shingles(r[1], k) for r in rows}
        links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = closure(sets, links)
        got = minhash.near_duplicates(spark.createDataFrame(rows + rows[:3], DOCS).repartition(5), k, percent).collect()
        assert len(got) == len(rows) + 3
        for r in got:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_clusters_are_settled_in_blocks(spark, monkeypatch):
    # chains of texts in which neighbours are linked and others aren't, so that stars leave several components
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows, now = [], list(base)
    for i in range(16):
        rows.append((i, " ".join(now)))
        now[rng.randrange(100)] = f"n{i}"
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    monkeypatch.setattr(minhash, "BLOCK_SETS", 4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_settle_links_every_pair_of_different_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 3)
    texts = [f"{'same words here ' * 3} and more of them " + " ".join(f"x{j}" for j in range(30)) + f" t{i // 2}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = docs.select(F.col("doc_id").alias("rep"), "doc_id", minhash.text_hash().alias("text_hash"))
    members = spark.createDataFrame([(0, i, 0 if i < 25 else i, 40) for i in range(40)], "hub long, rep long, component long, n_shingles long")
    links = [(r.a, r.b) for r in minhash.settle(members, reps, docs, 3, 85).collect()] + [(0, i) for i in range(25)]
    assert set(closure(range(40), links).values()) == {0}


def test_one_id_with_several_texts_loses_no_link(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    got = minhash.near_duplicates(spark.createDataFrame([(1, a), (1, b), (2, b + " more"), (None, a + " tail"), (7, "alone")], "doc_id long, text string"), 3, 85).collect()
    found = sorted((r.n_shingles, r.doc_id or 0, r.component_id or 0) for r in got)
    assert found == [(1, 7, 7), (48, 1, 1), (48, 1, 1), (49, 0, 1), (49, 2, 1)]


def test_a_row_without_id_takes_no_part_in_its_component_s_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (None, text), (None, "two of them"), (None, "two of them")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (0, 1, False), (1, 1, True), (2, 1, False)]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_registers_merge_to_those_of_the_union():
    xors, odds = minhash._constants(64)
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 2**63, (2, 500), dtype=np.uint64)
    join = np.maximum(minhash.registers(a, xors, odds), minhash.registers(b, xors, odds))
    assert (join == minhash.registers(np.concatenate([a, b]), xors, odds)).all()


def test_joint_likelihood_is_largest_near_the_true_similarity():
    xors, odds = minhash._constants(400)
    rng = np.random.default_rng(2)
    x = rng.integers(1, 2**63, 1400, dtype=np.uint64)
    r1, r2 = minhash.registers(x[:1200], xors, odds).astype(int), minhash.registers(x[200:], xors, odds).astype(int)
    d = [np.array([v.sum()]) for v in (r1 > r2, r1 < r2, r1 == r2)]
    grid = np.linspace(0.4, 1, 121)
    best = max(grid, key=lambda j: minhash.log_likelihood(np.array([j]), np.array([0.5]), *d)[0])
    assert abs(best - 1000 / 1400) < 0.08


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 101, 102), 100)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    near = [b + rng.standard_normal(16) * s for b in base[:12] for s in (0.02, 0.1, 0.3)]
    rows = [[float(x) for x in v] for v in [*base, *near, base[0] * 3, base[0], base[0]]]
    rows += [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 0.0, 0.0], [2.0, 0.0, 0.1], [1e200] * 16, [1e-200] * 16]
    table = [(i, r, 5, "x") for i, r in enumerate(rows)]
    unit = {}
    for i, r, *_ in table:
        if r and None not in r and np.isfinite(r).all() and np.abs(r).max() > 0:
            v = np.array(r) / np.abs(r).max()
            unit[i] = v / np.linalg.norm(v)
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    want = closure(range(len(table)), links)
    df = spark.createDataFrame(table + table[:4], "vec_id long, embedding array<double>, label int, rep string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert sorted(got) == list(range(len(table)))
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (sum(i in x for x in links), want[i], want[i] == i)
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_two_vectors_of_one_id_stay_apart(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (None, [-1.0, 0.0]), (None, None)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, False), (0, 0, 0, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(12)
    size, pairs, others = 64, 600, 4000
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a, noise = unit(rng.standard_normal((pairs, size))), rng.standard_normal((pairs, size))
    across = unit(noise - (noise * a).sum(axis=1, keepdims=True) * a)
    cosine = 0.9501
    b = cosine * a + np.sqrt(1 - cosine**2) * across
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b, unit(rng.standard_normal((others, size)))]))]
    got = {r.vec_id: r.component_id for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)).collect()}
    found = sum(got[pairs + i] == i for i in range(pairs))
    assert found >= 0.99 * pairs and sum(got[i] != i for i in range(2 * pairs, 2 * pairs + others)) == 0


def test_collision_plan_keeps_its_recall():
    for n in (10, 10_000, 10_000_000):
        signs, groups, need, half = vectors.plan(n, 0.95)
        assert need >= 1 and groups >= 16 and half > 0 and signs >= 2
