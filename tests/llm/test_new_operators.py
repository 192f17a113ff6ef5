"""Mixing, prefix trie and importance resampling against plain Python versions, with the cases that tables bring along."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from quayside.llm import importance, mixture, prefix_trie
from quayside.llm.queries import op11_mixture, op12_prefix_trie, op13_importance

DOCS = "doc_id long, text string, source string, size long, weight long, block long, rank long, before long, start long"
BLANK = r"[^\x20\x09-\x0D]+"


def texts(rng, n):
    words = [f"w{i}" for i in range(300)] + ["Ünï", "ÉCOLE", "A1", "x" * 90]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def write(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# mixing


def filled(sizes, weights, most):
    """Water filling by bisection on the level."""
    total, lo, hi = sum(sizes), 0.0, 1e9
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(w * level, most * s) for s, w in zip(sizes, weights, strict=True)) < total else (lo, level)
    return [min(w * hi, most * s) for s, w in zip(sizes, weights, strict=True)]


def test_targets_fill_up_to_the_limit():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 7, 500, rng.randrange(10_000)]) for _ in range(rng.randrange(1, 9))]
        weights = [k % 3 + 1 for k in range(len(sizes))]
        got = mixture.filled(sizes, weights, 3)
        assert np.allclose(got, filled(sizes, weights, 3), rtol=1e-9, atol=1e-6) and math.isclose(sum(got), sum(sizes), abs_tol=1e-6)


def test_permutations_take_every_place_once():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        x = np.arange(n)
        orders = [mixture.permuted(x, np.full(n, n), np.full(n, key, np.uint64)) for key in (1, 2)]
        assert all(sorted(o.tolist()) == list(range(n)) for o in orders)
        assert n < 64 or (orders[0] != orders[1]).any()


def test_shards_draw_all_slots():
    counts = mixture.shard_counts([1000, 0, 5, 40], 7, 1)
    assert counts.sum(axis=0).tolist() == [1000, 0, 5, 40] and np.ptp(counts.sum(axis=1)) <= 1
    assert mixture.shard_counts([0, 0], 3, 1).sum() == 0


def test_mixture_meets_its_targets(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, t, rng.choice(["a", "a", "a", "B", "ü", None])) for i, t in enumerate(texts(rng, 400))]
    rows += [(None, "one two three", "a"), (1000, None, "a"), (1001, "", "empty"), (1002, " \n\t", None), (1003, "long " * 5000, "B"), (3, "again and again", "a"), (3, "again and again", "a")]
    d = write(spark, tmp_path, documents=([(i, t, s, 9, 9, 9, 9, 9, 9) for i, t, s in rows], DOCS))
    got = op11_mixture(spark, d).collect()
    size = lambda t: len(re.findall(BLANK, t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, filled([total[s] for s in names], [k % 3 + 1 for k in range(len(names))], 3), strict=True))
    source = {(i, size(t)): s for i, t, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == total[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)
    again = op11_mixture(spark, d)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))


def test_slots_hold_the_words_of_their_blocks(spark):
    rng = random.Random(8)
    rows = [(i, t, rng.choice("ab")) for i, t in enumerate(texts(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    m = mixture.mix_sources(docs, block=16, shards=4)
    stream = {s: [w for _, t, own in rows if own == s for w in re.findall(BLANK, t)] for s in "ab"}
    slots = {(r.shard, r.slot): r for r in m.slots.collect()}
    out = m.texts(docs).collect()
    assert len(out) == len(slots) == m.slots.count()
    seen = Counter()
    for r in out:
        s = slots[r.shard, r.slot]
        words = stream[m.sources[r.source_no].name][16 * s.block :][: s.n_words]
        assert r.text.split(" ") == words
        seen[r.source_no, s.block] += 1
    for k, s in enumerate(m.sources):  # copies differ by one at most
        n = [seen[k, b] for b in range(s.blocks)]
        assert max(n) - min(n) <= 1


def test_mixture_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    m = mixture.mix_sources(empty)
    assert m.taken().count() == m.slots.count() == m.pieces.count() == 0
    one = mixture.mix_sources(spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string"))
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in one.taken().collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# prefix trie


def plain_trie(rows, share=20, most=4):
    """{(smallest member, depth): figures} by one pass over every conversation's turns, and the sums from the leaves up."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[c].append((turn is not None, turn or 0, mark, role, text))
    for v in by.values():
        v.sort()
    members, ends, up, last, known = defaultdict(list), defaultdict(list), {}, {}, {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % most
        node = 0
        members[0].append(c)
        for depth, (*_, role, text) in enumerate(by.get(c - c % share, [])[:h] + by[c][h:], 1):
            child = known.setdefault((node, role, text), len(known) + 1)
            up[child], last[child] = node, (depth, text)
            members[child].append(c)
            node = child
        ends[node].append(c)
    kids = defaultdict(list)
    for node, parent in up.items():
        kids[parent].append(node)
    leaves, saved, out = {}, {}, {}
    for node in sorted(members, reverse=True):  # children have higher numbers
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(re.findall(BLANK, last[node][1])) if node else 0)
        ids = ",".join(map(str, sorted(ends[node])))
        out[min(members[node]), last[node][0] if node else 0] = (min(members[up[node]]) if node else None, len(members[node]), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest())
    return out


CONVS = "conv_id long, turn long, role string, text string, depth long, block long, a string, before long, one int"


def test_trie_equals_plain_version(spark, tmp_path):
    rng = random.Random(5)
    openings = [[("user", t) for t in texts(rng, k)] for k in (1, 3, 7, 8, 9, 20)]
    rows = []
    for c in range(150):
        turns = list(rng.choice(openings)) if c % 3 else []
        turns += [(rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d  e\tf"])) for _ in range(rng.randrange(0, 12))]
        rows += [(c, None if not k and c % 2 else k, role, text) for k, (role, text) in enumerate(turns)]
    rows += [(7, 3, "user", "same turn"), (7, 3, "user", "other text"), (7, 3, "user", "same turn"), (None, 1, "user", "of no conversation")]
    rows += [(c, k, "user", f"turn {k}") for c in (400, 401, 402) for k in range(60)]  # the same long one
    rows += [(500 + c, 0, "user", "hot") for c in range(300)]
    rng.shuffle(rows)
    d = write(spark, tmp_path, conversations=([(*r, 1, 1, "x", 1, 1) for r in rows], CONVS))
    got = op12_prefix_trie(spark, d).collect()
    want = plain_trie(rows)
    assert len(got) == len(want)
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == want


def test_long_conversations_are_summed_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    rows = [(c, k, "user", f"turn {min(k, 90 + c)}") for c in (20, 40, 60) for k in range(150)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got.drop("turn_id").collect()} == plain_trie(rows)


def test_lists_of_ends_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = [(c, 0, "user", "hot") for c in range(0, 4000, 2)] + [(1, 0, "user", "cold")]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got.drop("turn_id").collect()} == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], CONVS)).count() == 0
    turns = spark.createDataFrame([(21, None, None, None)], "conv_id long, turn long, role string, text string")  # crc32("21") % 4 is 1, and 20 is absent
    nodes = prefix_trie.conversation_trie(turns)
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in nodes.collect()] == [(21, 0, 1, 1)] if zlib.crc32(b"21") % 4 else nodes.count() == 2
    known = {r.depth: (r.role, r.text) for r in prefix_trie.with_turns(prefix_trie.conversation_trie(spark.createDataFrame([(20, 1, "user", "Hi there")], turns.schema)), spark.createDataFrame([(20, 1, "user", "Hi there")], turns.schema)).collect()}
    assert known == {0: (None, None), 1: ("user", "Hi there")}


# importance resampling


def plain_words(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_resample(docs, target, percent=10, least=20, most=1, buckets=10_000, seed=2024):
    bags = lambda text: [zlib.crc32(b" ".join(w[i : i + k])) % buckets for w in [plain_words(text)] for k in range(1, most + 1) for i in range(len(w) - k + 1)]
    raw, wanted = Counter(b for _, t in docs for b in bags(t)), Counter(b for t in target for b in bags(t))
    own, all_ = raw.total() + buckets, wanted.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * own / ((raw[b] + 1) * all_)))
    out = []
    for i, t in docs:
        bag = bags(t)
        weight = sum(map(gain, bag)) // len(bag) if bag else 0
        h = None if i is None else int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bag), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(t))])
    able = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def test_resampling_equals_plain_version(spark, tmp_path):
    rng = random.Random(9)
    rows = list(enumerate(texts(rng, 500)))
    rows += [(None, "w1 " * 30), (None, None), (900, None), (901, ""), (902, "..."), (903, "w5 " * 40_000), (904, "y" * 100_000)]
    rows += [(950, "many equal rows of one id " * 5)] * 90
    target = [t for _, t in rows[:20]] + [None, ""]
    d = write(spark, tmp_path, documents=([(i, t, "s", 1, 1, 1, 1, 1, 1) for i, t in rows], DOCS), benchmark=([(k, t) for k, t in enumerate(target)], "item_id long, text string"))
    got = op13_importance(spark, d)
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == plain_resample(rows, target)
    assert importance.drawn(spark.read.parquet(f"{d}/documents.parquet"), got.filter("doc_id <> 950")).count() == got.filter("doc_id <> 950 and rank is not null").count()


def test_resampling_by_runs_of_words(spark):
    rng = random.Random(10)
    rows = list(enumerate(texts(rng, 150)))
    docs, target = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for _, t in rows[:9]], "text string")
    got = importance.resample(docs, target, percent=25, least_words=5, most=3, buckets=777, seed=1).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == plain_resample(rows, [t for _, t in rows[:9]], 25, 5, 3, 777, 1)


def test_planes_give_exact_sums():
    rng = np.random.default_rng(2)
    for gain in (rng.integers(-9000, 9000, 500), np.full(500, -1), np.full(500, 7), np.zeros(500, int)):
        row, bucket = np.sort(rng.integers(0, 30, 9000)), rng.integers(0, 500, 9000) ** 2 // 500
        want = np.bincount(row, gain[bucket], 30).astype(np.int64)
        assert importance.plane_sums(row, bucket, 30, 500, importance.gain_planes(gain)).tolist() == want.tolist()


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert importance.resample(empty, empty).count() == 0
    one = importance.resample(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), empty).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in one] == [(1, 3, None)]
