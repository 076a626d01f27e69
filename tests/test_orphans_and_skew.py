import datetime as dt

from pyspark.sql import functions as F

from graphloom.operators.latest import latest
from graphloom.operators.orphans import track
from graphloom.operators.skew import count_distinct_per_key, heavy_keys

D = lambda m, d=1: dt.datetime(2025, m, d)
REFS = "ref_id long, kind string, key string, at timestamp, loaded timestamp, status string, period string"
PARENTS = "kind string, key string, arrived timestamp, stamp timestamp, deleted_at timestamp, seen timestamp, last string"


def run(spark, refs, parents, **k):
    r = spark.createDataFrame([(*x, "s", "p") for x in refs], REFS)
    p = spark.createDataFrame([(*x, "l") for x in parents], PARENTS)
    state = track(r, p, **k)
    final = state.verdicts()
    return (state, final) if k else (final, state.snapshots())


def test_orphans_wait_resolve_and_reopen(spark):
    refs = [(1, "t", "a", D(1), D(1)), (2, "t", "a", D(4), D(4)), (3, "t", "a", D(6), D(8)), (4, "t", "b", D(1), D(1)), (5, "t", "b", D(1), None), (5, "t", "b", D(1), None), (6, "t", None, D(1), D(1)), (None, "t", "a", D(1), D(1)), (7, "t", "c", D(3), D(3))]
    parents = [("t", "a", D(2), D(2), None, D(2)), ("t", "a", D(5), D(5), D(5, 2), D(5)), ("t", "a", D(5), D(5), D(5, 2), D(5)), ("u", "b", D(1), D(1), None, D(1)), ("t", "c", None, None, None, D(9))]
    final, snaps = run(spark, refs, parents)
    assert {r.ref_id: r.status for r in final.collect()} == {1: "late", 2: "found", 3: "deleted", 4: "missing", 5: "missing", 7: "found"}
    seen = {(r.as_of, r.month, r.status): r.n for r in snaps.collect()}
    assert seen[("2025-01", "2025-01", "missing")] == 3  # 1, 4 and 5 wait
    assert seen[("2025-02", "2025-01", "missing")] == 2  # a has come
    assert seen[("2025-02", "2025-01", "late")] == 1
    assert seen[("2025-03", "2025-03", "missing")] == 1 and ("2025-09", "2025-03", "missing") not in seen
    assert seen[("2025-09", "2025-01", "missing")] == 2  # 4 and 5 still wait: a snapshot holds every group


def test_a_period_judges_what_moved_in_it(spark):
    refs = [(n, "t", f"k{n % 50}", D(1), D(1)) for n in range(500)] + [(900, "t", "k0", D(2), D(2))]
    parents = [("t", "k7", D(3), D(3), None, D(3)), ("t", "nobody", D(4), D(4), None, D(4)), ("t", "k7", D(5), D(5), D(5, 2), D(5))]
    state, final = run(spark, refs, parents, count=True)
    assert state.judged == {"2025-01": 500, "2025-02": 1, "2025-03": 10, "2025-05": 10}
    assert {r.status for r in final.where("ref_id % 50 = 7").collect()} == {"late"}


def test_a_later_version_revives_a_parent(spark):
    final, _ = run(spark, [(1, "t", "a", D(3), D(3))], [("t", "a", D(1), D(1), D(2), D(1)), ("t", "a", D(4), D(4), None, D(4))])
    assert final.first().status == "found"


def test_no_references_and_a_heavy_key(spark):
    assert run(spark, [], [("t", "a", D(1), D(1), None, D(1))])[0].count() == 0
    refs = [(n, "t", "hot" if n % 3 else f"k{n}", D(2), D(2)) for n in range(600)]
    final, _ = run(spark, refs, [("t", "hot", D(1), D(1), None, D(1))])
    assert final.where("status = 'found'").count() == 400 and final.where("status = 'missing'").count() == 200


def test_salted_counts_equal_plain_ones(spark):
    rows = [("hot", n % 700) for n in range(2000)] + [(f"k{n}", n) for n in range(100)] + [(None, 1), ("hot", None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "k string, m long, __salt int, __n int")
    got = {r.k: r.n for r in count_distinct_per_key(df, "k", "m").collect()}
    assert got == {"hot": 700} | {f"k{n}": 1 for n in range(100)}
    assert count_distinct_per_key(df.limit(0), "k", "m").count() == 0
    assert [h[0] for h in heavy_keys(df, ["k"], 1 / 4)] == ["hot"]


def test_latest_version(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "y"), ("a", None, "z"), (None, 9, "n"), ("b", None, None)], "k string, at int, v string")
    assert {(r.k, r.v) for r in latest(df, "k", "at", ["v"]).collect()} == {("a", "y"), ("b", None)}
    assert latest(df.where(F.lit(False)), "k", "at", ["v"]).count() == 0
