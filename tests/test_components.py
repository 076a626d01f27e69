import random

from graphloom.operators.components import components
from graphloom.operators.lookups import lookup
from graphloom.operators.repair import merge_domains


def test_components_agree_with_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(n, n + 1) for n in range(300, 360)] + [(1000, n) for n in range(1001, 1400)] + [(None, 3), (5, 5), (1, None)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if None not in (a, b) and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for n in up}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_a_heavy_hub(spark, monkeypatch):
    from graphloom.operators import components as module

    monkeypatch.setattr(module, "LEAST_HEAVY", 10)
    links = [(7, n) for n in range(100, 600)] + [(n, n + 1000) for n in range(100, 200)]
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert len(got) == 601 and {r.component for r in got} == {7}


def test_domains_in_a_long_chain_become_one(spark):
    members = spark.createDataFrame([(f"p{n}", f"d{n:03d}") for n in range(120)] + [("q", "d007"), ("x", "alone")], "program string, domain string")
    pairs = spark.createDataFrame([(f"d{n:03d}", f"d{n + 1:03d}") for n in range(119)], "a string, b string")
    got = {r.program: r.domain for r in merge_domains(members, pairs).collect()}
    assert set(got.values()) == {"d007", "alone"} and len(got) == 122
    assert merge_domains(members, pairs.limit(0)).count() == 122


def test_lookup_keeps_rows_without_a_match(spark):
    left = spark.createDataFrame([("hot", n) for n in range(50)] + [("a", 1), (None, 2)], "k string, n int")
    right = spark.createDataFrame([("hot", "h"), ("b", "x")], "k string, v string")
    got = lookup(left, right, ["k"]).collect()
    assert len(got) == 52 and sum(r.v == "h" for r in got) == 50
