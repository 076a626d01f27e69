import random

from graphloom.operators.hierarchy import ancestor_pairs, forest, nest_by_level

ITEMS = "program string, line int, level int, id long, grp string, block long, key string"


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], ITEMS)


def brute_parents(rows):
    rows = set(rows)
    out = {}
    for p, ln, lv, i in rows:
        best = None
        if None not in (p, ln, lv):
            for q, l2, v2, j in rows:
                if q == p and None not in (l2, v2) and l2 < ln and v2 < lv and (best is None or (l2, j) > best):
                    best = (l2, j)
        out[i] = best and best[1]
    return out


def test_nesting_agrees_with_brute_force_in_one_block_and_in_many(spark):
    rng = random.Random(3)
    rows = [(p, n, rng.choice([1, 5, 5, 10, 15, 49]), 1000 * k + n) for k, p in enumerate("ABC") for n in range(60)]
    rows += rows[:20]
    rows += [(None, 1, 1, 9001), ("A", None, 5, 9002), ("A", 7, None, 9003)]
    want = brute_parents(rows)
    for block in (1_000_000, 7):
        got = nest_by_level(items(spark, rows), "program", "line", "level", "id", block_lines=block).collect()
        assert len(got) == len(want)
        assert {r.key: r.parent for r in got} == want


def test_items_on_one_line_do_not_nest_in_each_other(spark):
    got = nest_by_level(items(spark, [("A", 1, 1, 1), ("A", 2, 5, 2), ("A", 2, 10, 3), ("A", 3, 15, 4)]), "program", "line", "level", "id").collect()
    assert {r.key: r.parent for r in got} == {1: None, 2: 1, 3: 1, 4: 3}


def brute_forest(links):
    parent = {}
    for n, p in links:
        if n is not None:
            parent[n] = p if n not in parent or parent[n] is None else (parent[n] if p is None else min(p, parent[n]))
    parent = {n: (p if p in parent else None) for n, p in parent.items()}
    out = {}
    for n in parent:
        path, x = [n], n
        while parent[x] is not None and parent[x] not in path:
            x = parent[x]
            path.append(x)
        out[n] = (None, None, None) if parent[x] is not None else (x, len(path) - 1, path[::-1])
    return out


def test_forest_paths_loops_and_strays(spark):
    rng = random.Random(5)
    links = [(n, rng.randrange(n) if n and rng.random() < 0.95 else None) for n in range(300)]
    links += [(400, 401), (401, 402), (402, 400), (403, 401), (404, 404)]  # a loop, one that hangs on it, a node in itself
    links += [(500, 999), (None, 3), (7, links[7][1])]  # a parent without a row, no node, a repeat
    links += [(600 + k, 599 + k if k else None) for k in range(120)]  # deeper than a round at one width
    got = {r.node: (r.root, r.depth, r.path) for r in forest(spark.createDataFrame(links, "id long, up long"), "id", "up").collect()}
    assert got == brute_forest(links)


def test_forest_of_nothing_and_of_text_keys(spark):
    assert forest(spark.createDataFrame([], "id long, up long"), "id", "up").count() == 0
    got = {r.node: r.path for r in forest(spark.createDataFrame([("a", None), ("b", "a"), ("x", "x")], "id string, up string"), "id", "up").collect()}
    assert got == {"a": ["a"], "b": ["a", "b"], "x": None}


def test_heavy_parent_and_descendants(spark):
    links = [(0, None)] + [(n, 0) for n in range(1, 2000)] + [(5000, 17)]
    placed = forest(spark.createDataFrame(links, "id long, up long"), "id", "up")
    assert placed.where("depth = 1").count() == 1999
    pairs = {(r.ancestor, r.descendant, r.distance) for r in ancestor_pairs(placed).where("descendant = 5000").collect()}
    assert pairs == {(17, 5000, 1), (0, 5000, 2)}
