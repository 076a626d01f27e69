import random

import numpy as np

from graphloom.llm.leakage import Index, _hashes, edit_distance, leaks, words


def test_words():
    assert words("Ｆull­-wi​dth É 9x") == ["full", "width", "9x"]
    assert words(None) == words("") == []


def runs(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_shared_runs_agree_with_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{n}" for n in range(30)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randrange(5, 40))) for k in range(12)]
    docs = []
    for k in range(60):
        t = text(rng.randrange(0, 60))
        if k % 2:
            w = words(rng.choice(items)[1])
            n = rng.randrange(9, 16)
            at = rng.randrange(max(1, len(w) - n))
            t = t + " " + ", ".join(w[at : at + n]).upper() + "! " + text(rng.randrange(0, 9))
        docs.append((k, t))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, "x " * 200_000 + items[-1][1])]
    items += [(50, None), (51, ""), (52, "too short"), (None, "w1 " * 20), items[0]]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, edits int, item_id long")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {(a, b) for a, t in docs if a is not None and t for b, s in items if b is not None and s and runs(t, 12) & runs(s, 12)}
    got = leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


def test_items_in_several_passes(spark, monkeypatch):
    from graphloom.llm import leakage

    monkeypatch.setattr(leakage, "PASS_WORDS", 40)
    items = [(k, " ".join(f"a{k}b{n}" for n in range(20))) for k in range(9)]
    d = spark.createDataFrame([(k, "so " + t) for k, t in items], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(k, k) for k in range(9)}


def test_edited_passages_reach_the_recall(spark):
    rng = random.Random(6)
    vocab = [f"w{n}" for n in range(4000)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(60))) for k in range(40)]
    docs = []
    for k, t in items:
        w = words(t)[15:45]
        for at in (8, 20):
            w[at] = "other"
        docs.append((k, " ".join(rng.choice(vocab) for _ in range(30)) + " " + " ".join(w)))
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=24, edits=2, bits=10, recall=0.95).collect()
    assert all(r.doc_id == r.item_id and r.edits <= 2 for r in found)
    assert len(found) >= 0.9 * len(docs)


def test_every_kind_of_edit_reaches_the_recall():
    rng = random.Random(12)
    vocab = [f"w{n}" for n in range(4000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(some(60))) for k in range(150)]
    index = Index(items, window=24, edits=2, bits=10, recall=0.95, seed=7)
    for kinds in ("ss", "ii", "dd", "si", "sd", "id"):
        docs = []
        for _, t in items:
            at = rng.randrange(36)
            w = t.split()[at : at + 24]
            for p, kind in zip(sorted(rng.sample(range(1, 24), 2), reverse=True), kinds):
                w[p : p + (kind != "i")] = [] if kind == "d" else ["other"]
            docs.append(some(30) + w + some(30))
        hits = index.hits(docs, _hashes([x for d in docs for x in d], {}))
        assert sum((k, k) in hits for k in range(len(docs))) >= 0.91 * len(docs), kinds
        assert all(d <= 2 for d in hits.values())


def test_edit_distance():
    assert edit_distance(list("kitten"), list("sitting"), 3) == 3 and edit_distance(list("kitten"), list("sitting"), 2) == 3 and edit_distance([], [], 0) == 0
