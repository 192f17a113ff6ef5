import random

from quayside.operators.dedup import first_seen


def test_first_seen_equals_the_sequential_pass(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(50), [rng.choice(["hot", *map(str, range(40))]) for _ in range(rng.randrange(0, 3))]) for i in range(300)]
    keys = [(i, o, k) for i, o, ks in rows for k in (ks or [None])]
    got = {r.id: (r.kept, r.of) for r in first_seen(spark.createDataFrame(keys, "id long, ord int, key string")).collect()}
    by: dict[str, int] = {}
    for i, o, ks in sorted(rows, key=lambda r: (r[1], r[0])):
        old = [by[k] for k in ks if k in by]
        if not old:
            by |= dict.fromkeys(ks, i)
        assert got[i][0] == (not old), i
        if not old:
            assert got[i][1] == i
        else:
            assert got[i][1] in old
    assert first_seen(spark.createDataFrame([], "id long, ord int, key string")).collect() == []
