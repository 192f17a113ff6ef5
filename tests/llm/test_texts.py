"""Line windows, windows of benchmark items, shards, byte pairs and url templates against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quayside.llm import bpe, decontaminate, line_dedup, sharding, url_filter

PATH = public_tokenizers.path("byte_bpe_50k.json")


def lines_brute(rows, size=3):
    first, wins = {}, defaultdict(list)
    for doc, text in sorted({(d, t) for d, t in rows if t}):
        ls = text.split("\n")
        k = min(size, len(ls))
        for p in range(len(ls) - k + 1):
            wins[tuple(ls[p : p + k])].append((doc, p))
    gone = defaultdict(set)
    for win, places in wins.items():
        for doc, p in sorted(places)[1:]:
            gone[doc] |= set(range(p, p + len(win)))
    return {d: (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])) for d, t in rows}


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    pool = ["a", "b", "c", "", "d e", "f"]
    texts = [None, "", "\n", "a", "a", "a\nb", "a\nb", "a\nb\nc\nx", "y\na\nb\nc\nx\nz"] + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    texts += ["\n".join(f"line {i}" for i in range(3000))] * 2 + ["r\n" * 500]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "x", 1, "r") for d, t in rows], "doc_id long, text string, lang string, n_lines int, runs string").repartition(3)
    got = line_dedup.dedup_lines(df)
    assert set(got.columns) == {"doc_id", "text", "lang", "runs", "n_lines", "n_removed"}
    want = lines_brute(rows)
    for r in got.collect():
        assert r.text == want[r.doc_id], r.doc_id
        assert r.n_lines == (0 if texts[r.doc_id] is None else len(texts[r.doc_id].split("\n")))
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]


def test_one_id_with_several_texts_loses_no_unique_line(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "p\nq\nr\ns"), (0, "a\nb\nc"), (None, "k\nl\nm"), (None, "k\nl\nm\nn"), (5, "k\nl\nm")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, `__of__` int, runs int, lines int, doc int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    texts = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in got.collect())
    rest = [(0, "a\nb\nc"), (1, "d"), (1, "p\nq\nr\ns"), (5, "")]
    # which of the texts without id comes first is settled by their hash
    assert texts in ([(-1, ""), (-1, "k\nl\nm\nn"), *rest], [(-1, "k\nl\nm"), (-1, "n"), *rest])



def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if c.isascii() else c
        if not c.isascii() or c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def windows_brute(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for p in range(len(w) - k + 1) if w else ():
            wins[tuple(w[p : p + k])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in wins:
                    hit |= set(range(p, p + k))
                    ids |= wins[tuple(w[p : p + k])]
        out[d] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_benchmark_windows_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    rng = random.Random(8)
    vocab = ["Alpha", "beta", "gámma", "d9", "e", "the"]
    say = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 9, 10, 12, 25]))) for i in range(12)] + [(1, "beta the d9 e e e"), (50, None), (51, "?!"), (52, ""), (None, "alpha")]
    docs = [(i, say(rng.randrange(0, 40))) for i in range(60)] + [(100, None), (101, ""), (102, "x " + items[5][1].upper() + " y"), (103, "z" * 200_000 + " " + items[6][1])]
    df = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, items string").repartition(3)
    want = windows_brute(docs, [x for x in items if x[0] is not None])
    for r in decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect():
        assert (r.n_words, sum(s.stop - s.start for s in r.spans), sorted(r["items"])) == want[r.doc_id], r.doc_id
    none = decontaminate.contamination(df, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(docs) and not any(r["items"] for r in none)
    assert decontaminate.contamination(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def smallest_capacity(sizes, shards):
    lo, hi = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while lo < hi:
        mid, n, load = (lo + hi) // 2, 1, 0
        for s in sizes:
            n, load = (n + 1, s) if load + s > mid else (n, load + s)
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize(("n", "shards", "large"), [(0, 4, 0), (1, 4, 0), (3, 5, 0), (200, 7, 0), (3000, 40, 0), (3000, 40, 150_000)])
def test_capacity_is_the_smallest(spark, n, shards, large):
    rng = np.random.default_rng(n)
    keys, sizes = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(16, 3000, n)
    if large:
        sizes[7] = large
    df = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes, strict=True)], "key long, size long")
    capacity, begins = sharding.balanced(df, shards)
    if not n:
        assert (capacity, begins) == (0, [])
        return
    order = np.argsort(keys)
    assert capacity == smallest_capacity(sizes[order].tolist(), shards)
    loads = np.bincount(np.searchsorted(np.array(begins, np.int64), keys[order], side="right"), weights=sizes[order])
    assert len(loads) <= shards and loads.max() == capacity
    if large:
        assert np.sort(loads)[-2] < 1.2 * (sizes.sum() - large) / (shards - 1)


def test_shards_number_their_rows_without_gaps(spark):
    rows = [(i, ["same", None, "", f"text {i} " * (i % 9)][i % 4], "x", 3) for i in range(400)] + [(0, "same", "x", 3)]
    got = sharding.shard_bytes(spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int"), 6).collect()
    assert len(got) == len(rows)
    slots, of = defaultdict(list), defaultdict(set)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        slots[r.shard].append(r.slot)
        of[text[r.doc_id] or ""].add(r.shard)
        assert r["size"] == len((text[r.doc_id] or "").encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    assert all(len(s) == 1 for s in of.values())


def test_ids_and_texts_equal_the_library(spark, monkeypatch):
    t = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(1)
    odd = ["", None, "a  b", " \n\n x\t y ", "   x", "a<|endoftext|> b  <|endoftext|>", "é\u0085 z", "can't won't  'll 's", "x" * 5000, "日本 語　 中", "\n", "a\u00a0 b", "tab\tcr\r\nnl", "🙂 🙂🙂  é x", "same text here"] * 2
    letters = list("ab'sé  \n\t \u0085,1<|endoftext|>")
    odd += ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i // 2, x, "y") for i, x in enumerate(odd)], "doc_id long, text string, ids string").repartition(3)
    got = sorted((r.doc_id, r.ids, r.text) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect())
    want = sorted((i // 2, np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes(), x or "") for i, x in enumerate(odd))
    assert [(g[0], bytes(g[1]), g[2]) for g in got] == want
    assert bpe.encode(df.limit(0), PATH).collect() == []
    for chunk in (1, 500, 1 << 20):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        got = sorted((r.doc_id, r.ids, r.text) for r in bpe.encode(df, PATH, decoded=True).collect())
        assert [(g[0], bytes(g[1]), g[2]) for g in got] == want


def test_distinct_words_come_back_by_position(spark, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 100)
    texts = [" ".join(f"word{(i * j) % 37}" for j in range(50)) for i in range(40)]
    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    assert got == {i: np.array(t.encode(x).ids, "<u4").tobytes() for i, x in enumerate(texts)}


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1")]


def test_rules_and_templates(spark):
    urls = {
        1: "http://Example.ORG/es/4", 2: "https://www.example.org/en/12?x#y", 3: "https://a.org/b", 4: "https://notexample.org", 5: None, 6: "no scheme/x", 7: "x://h?p/q", 8: "http://org/",
        **{100 + i: f"https://bad.com/junk/{i}" for i in range(60)}, **{200 + i: f"https://bad.com/good/{i}.html" for i in range(60)},
    }
    labels = [(k, k >= 200) for k in urls if k >= 100] + [(100, None), (999, True)]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in urls.items()], "page_id long, url string, template string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, spark.createDataFrame(labels, "page_id long, good boolean"), RULES).collect()}
    assert len(got) == len(urls)
    assert [(got[k].host, got[k].path) for k in range(1, 9)] == [("example.org", "/es/4"), ("www.example.org", "/en/12"), ("a.org", "/b"), ("notexample.org", ""), ("", ""), ("", ""), ("h", ""), ("org", "/")]
    assert [(got[k].rule, got[k].verdict) for k in (1, 2, 3, 4, 8)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, "allow"), ("org/", "allow")]
    assert {got[k].verdict for k in urls if 100 <= k < 200} == {"block"} and {got[k].verdict for k in urls if k >= 200} == {"allow"}
    assert got[100].template == "/junk/+" and got[200].template == "/good/+"
    assert url_filter.judge(pages.limit(0), spark.createDataFrame([], "page_id long, good boolean"), RULES).collect() == []


def test_templates_go_to_the_last_segment(spark):
    urls = [f"https://h.com/a/b/c/d/{kind}/p{i}" for kind in ("ok", "bad") for i in range(60)] + [f"https://h.com/a/b/c/d/{kind}/{i}/x/y" for kind in ("ok", "bad") for i in range(60)] + ["https://h.com/a", "https://other.com/" + "q/" * 300]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    labels = spark.createDataFrame([(i, "/ok/" in u) for i, u in enumerate(urls) if "/d/" in u], "page_id long, good boolean")
    got = url_filter.judge(pages, labels, []).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert r.verdict == ("block" if "/bad/" in urls[r.page_id] else "allow"), r
        assert r.template.count("/") == sum(1 for s in r.path.split("/") if s)
    assert {r.verdict for r in url_filter.judge(pages, labels.limit(0), []).collect()} == {"allow"}


def test_checksums_of_the_query_are_those_of_the_ids(spark):
    ids = np.array([1, 50256], "<u4").tobytes()
    df = spark.createDataFrame([(1, ids)], "doc_id long, ids binary")
    assert bpe.decode(df, PATH).first().text == '"<|endoftext|>'
    assert hashlib.sha256(ids).hexdigest() == df.selectExpr("sha2(ids, 256) as s").first().s
