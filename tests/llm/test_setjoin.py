import random
from collections import Counter

from graphloom.llm.setjoin import classes, expand, links, occurring, similar


def brute(rows, t, least):
    sets = {}
    for k, v in rows:
        if k is not None and v is not None:
            sets[k] = {x for x in v if x is not None}
    sets = {k: s for k, s in sets.items() if len(s) >= least}
    return {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_occurrence_counts(spark):
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(1, 50))) for _ in range(rng.randrange(1, 9))]
        t, start = rng.randrange(1, 8), rng.randrange(10)
        n = Counter(x for y in lists for x in y if x >= start)
        assert sorted(occurring(lists, t, start)) == sorted((k, c) for k, c in n.items() if c >= t)


def test_all_pairs_with_skew_copies_and_blocks(spark):
    rng = random.Random(4)
    base = [[f"v{rng.randrange(40)}" for _ in range(8)] for _ in range(25)]
    rows = []
    for k in range(260):
        s = list(rng.choice(base))
        if rng.random() < 0.6:
            s[rng.randrange(8)] = f"w{rng.randrange(200)}"
        rows.append((f"p{k:03d}", s + ["common", None, s[0]]))
    rows += rows[:5] + [("none", None), ("empty", []), (None, ["a", "b", "c", "d"]), ("small", ["a", "b"])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "id string, vals array<string>, class string, n int")
    sets = classes(df, "id", "vals", least=4)
    for t, block in ((0.75, 2000), (0.75, 3), (0.5, 7), (1.0, 50)):
        want = brute(rows, t, 4)
        pairs = similar(sets, t, block=block)
        got = expand(sets, pairs, block=block).collect()
        assert len(got) == len(want) and {(r.a, r.b): (r.overlap, r.together) for r in got} == want
    per = Counter(x for p in brute(rows, 0.75, 4) for x in p)
    assert {r.key: r.links for r in links(sets, similar(sets, 0.75)).collect() if r.links} == dict(per)


def test_nothing(spark):
    df = spark.createDataFrame([], "id string, vals array<string>")
    sets = classes(df, "id", "vals")
    assert similar(sets, 0.75).count() == 0 and links(sets, similar(sets, 0.75)).count() == 0
