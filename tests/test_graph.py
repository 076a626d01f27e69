import random

from pyspark.sql import functions as F

from graphloom.operators import incremental, repair, search, traverse, upsert
from graphloom.operators.inlining import inline


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_reach_has_least_depths_and_survives_cycles(spark):
    rng = random.Random(8)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)] + [("n1", "n1"), (None, "n2"), ("n3", None)]
    out = {}
    for a, b in pairs:
        if a and b:
            out.setdefault(a, set()).add(b)
    seeds = spark.createDataFrame([("k", "n1"), ("l", "n2")], "key string, node string")

    def brute(start, hops, restart):
        seen, level = ({} if restart else {start: 0}), {start}
        for h in range(1, hops + 1):
            level = {y for x in level for y in out.get(x, ())} - set(seen)
            seen |= dict.fromkeys(level, h)
        return seen

    for restart in (False, True):
        got = traverse.reach(edges(spark, pairs), seeds, 4, restart=restart).collect()
        assert {(r.key, r.node): r.depth for r in got} == {(k, n): d for k, s in (("k", "n1"), ("l", "n2")) for n, d in brute(s, 4, restart).items()}
        assert all(len(r.path) == r.depth + 1 and r.path[-1] == r.node for r in got)
    assert traverse.reach(edges(spark, pairs), seeds.limit(0), 3).count() == 0
    assert traverse.reach(edges(spark, []), seeds, 3, restart=True).count() == 0


def test_dead_nodes(spark):
    nodes = spark.createDataFrame([("p", x) for x in "abcd"] + [("q", "x"), ("q", "y")], "key string, node string")
    e = spark.createDataFrame([("p", "a", "b"), ("p", "c", "d"), ("p", "d", "c"), ("q", "x", "y"), ("q", "y", "x")], "key string, src string, dst string")
    assert {(r.key, r.node) for r in traverse.dead_nodes(nodes, e).collect()} == {("p", "c"), ("p", "d")}  # q has no entry


def test_dead_nodes_of_random_graphs(spark):
    rng = random.Random(5)
    nodes = {(k, n) for k in range(30) for n in range(8)}
    pairs = [(rng.randrange(31), *rng.choices([*range(9), None], k=2)) for _ in range(230)] + [(None, 1, 2), (40, 1, 2)]
    pairs += pairs[:20]
    e = [p for p in pairs if p[0] is not None and p[2] is not None]
    entries = nodes - {(k, b) for k, _, b in e}
    met = set(entries)
    for _ in range(20):
        met |= {(k, b) for k, a, b in e if (k, a) in met}
    want = {x for x in nodes - met if x[0] in {k for k, _ in entries}}
    n = spark.createDataFrame([*nodes, *list(nodes)[:9], (None, 3)], "key long, node long")
    got = [(r.key, r.node) for r in traverse.dead_nodes(n, spark.createDataFrame(pairs, "key long, src long, dst long")).collect()]
    assert want and sorted(got) == sorted(want)
    assert traverse.dead_nodes(n.limit(0), spark.createDataFrame([], "key long, src long, dst long")).count() == 0


def test_layers_follow_what_they_lead_to(spark):
    n = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    got = {r.node: (r.layer, r.tier) for r in traverse.layers(n, edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "d"), ("f", "d"), ("z", "a"), ("g", "g")])).collect()}
    assert got == {"c": (0, "LEAF"), "b": (1, "MIDDLE"), "a": (2, "ROOT"), "d": (None, "MIDDLE"), "e": (None, "MIDDLE"), "f": (None, "ROOT"), "g": (None, "MIDDLE")}


def test_upserts(spark):
    rows = spark.createDataFrame([("a", 1, "x", None, "c1"), ("a", 2, None, 5, "c2"), ("a", 3, "z", None, "c1"), (None, 9, "q", 1, "c"), ("b", None, "y", None, None)], "k string, s int, v string, n int, cb string")
    got = {r.k: (r.v, r.n, r.cb) for r in upsert.upsert(rows, "k", "s", ["v", "n"], ["cb"]).collect()}
    assert got == {"a": ("z", 5, ["c1", "c2"]), "b": ("y", None, [])}
    e = spark.createDataFrame([("T", "a", "b", 1, "old"), ("T", "a", "b", 2, "new"), ("T", "a", "x", 1, "v"), ("U", "a", "b", 1, None)], "type string, src string, dst string, s int, v string")
    n = spark.createDataFrame([("a",), ("b",)], "node string")
    assert {(r.type, r.src, r.dst, r.v) for r in upsert.upsert_edges(e, n, n, "s", ["v"]).collect()} == {("T", "a", "b", "new"), ("U", "a", "b", None)}
    assert [r.node for r in upsert.stubs(e, n).collect()] == ["x"]


def test_change_detection(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "partial:3")], "path string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("d", "4"), ("e", None)], "path string, hash string")
    assert {r.path for r in incremental.changed(now, state, ["path"]).collect()} == {"b", "c", "d"}
    done = incremental.mark(state, now.where("path in ('b', 'd')"), ["path"])
    assert {tuple(r) for r in done.collect()} == {("a", "1"), ("b", "9"), ("c", "partial:3"), ("d", "4")}
    again = incremental.mark(done, now.where("path = 'd'"), ["path"], partial=True)
    assert "d" in {r.path for r in incremental.changed(now, again, ["path"]).collect()}
    assert incremental.clear(done, now.where("path = 'a'"), ["path"]).count() == 3


def test_completion_and_first_row(spark):
    parts = spark.createDataFrame([("f", 0, 2), ("f", 1, 2), ("f", 1, 2), ("g", 0, 2), ("h", 5, 1), (None, 0, 1), ("i", 0, None)], "k string, i int, t int")
    assert {r.k: r.complete for r in incremental.complete(parts, "k", "i", "t").collect()} == {"f": True, "g": False, "h": False, "i": False}
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, None)], "k string, o int, v string")
    assert {(r.k, r.v) for r in incremental.first_wins(rows, ["k"], ["o"]).collect()} == {("a", "x"), ("b", None)}


def test_repairs(spark):
    p = spark.createDataFrame([("a", "f", "COBOL", False, True), ("b", None, None, None, True), ("c", None, None, None, True)], "id string, file_path string, language string, external boolean, dead boolean")
    c = edges(spark, [("a", "b"), ("b", "a")])
    assert {r.id: (r.external, r.language) for r in repair.mark_external(p, c).collect()} == {"a": (False, "COBOL"), "b": (True, "EXTERNAL"), "c": (False, None)}
    assert {r.id: r.dead for r in repair.revive(p, c, spark.createDataFrame([("c",)], "program string")).collect()} == {"a": True, "b": False, "c": False}
    m = spark.createDataFrame([("p1", "Long name"), ("p2", "Long name"), ("p1", "Ab"), ("p2", "Ab"), ("p3", "Cd"), ("p9", "Other")], "program string, domain string")
    merged = repair.merge_domains(m, spark.createDataFrame([("Ab", "Long name"), ("Ab", "Cd")], "a string, b string"))
    assert {tuple(r) for r in merged.collect()} == {("p1", "Ab"), ("p2", "Ab"), ("p3", "Ab"), ("p9", "Other")}
    assert {tuple(r) for r in repair.reassign(m, spark.createDataFrame([("p1", "New")], "program string, domain string")).where("program = 'p1'").collect()} == {("p1", "New")}
    cards = spark.createDataFrame([(1, "CUST", "A.B"), (2, "X", "PROD.CUST.DATA"), (3, "Y", "CUST"), (4, "Z", None)], "dd long, name string, dsname string")
    linked = repair.link_cards(cards, spark.createDataFrame([("CUST",)], "file string"))
    assert {(r.dd, r.method) for r in linked.collect()} == {(1, "name"), (2, "dsname")}
    paras = spark.createDataFrame([("p", "x", False), ("p", "y", False)], "program string, name string, reachable boolean")
    assert {r.name: r.reachable for r in repair.unmark(paras, spark.createDataFrame([("p", "x")], "program string, name string")).collect()} == {"x": True, "y": False}
    cleared, left = repair.clear_external(p.withColumn("external", F.col("id") == "b").withColumn("risk", F.lit(1.0)), m.withColumn("program", F.lit("b")), ["risk"])
    assert {r.id: r.risk for r in cleared.collect()} == {"a": 1.0, "b": None, "c": 1.0} and left.count() == 0


def test_inlining(spark):
    t = spark.createDataFrame([("p", "A\n       COPY BK1.\nB\n COPY GONE.\n COPY bk2 REPLACING ==:X:== BY ==NEW==."), (None, "x"), ("q", "plain")], "key string, text string")
    b = spark.createDataFrame([("BK1", "one\n COPY BK2.\n COPY BK1."), ("bk2", "two :X:"), (None, "n")], "name string, text string")
    got = {r.key: r.text for r in inline(t, b).collect()}
    assert got == {"p": "A\none\ntwo :X:\n COPY BK1.\nB\n COPY GONE.\ntwo NEW", "q": "plain"}
    assert inline(t.limit(0), b).count() == 0


def test_search(spark):
    d = spark.createDataFrame([(1, "red fish"), (2, "Red red, blue"), (3, "green " * 50 + "red"), (4, None), (5, "")], "id long, text string")
    assert [r.id for r in search.bm25(d, "id", "text", "red blue").collect()] == [2, 1, 3]
    assert search.bm25(d, "id", "text", " ").count() == 0 and search.bm25(d.limit(0), "id", "text", "red").count() == 0
