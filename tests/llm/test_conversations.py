from graphloom.llm import conversations as module
from graphloom.llm.conversations import assign, conversations, faults, identifier_links

MESSAGES = "id long, session_id string, role string, content string, seq int, component long, node string"


def judge(spark, rows, sessions, links=None):
    m = spark.createDataFrame([(*r, 1, "n") for r in rows], MESSAGES)
    placed = assign(m, links if links is not None else identifier_links(m))
    verdict = faults(placed, spark.createDataFrame([(s, "t") for s in sessions], "id string, fault string"))
    return placed, verdict


def test_faults_in_their_order(spark):
    u, a, s = "user", "assistant", "system"
    talks = {
        "ok": [(s, "be", 3), ("Human ", "q", 4), ("AI", "a", 5)],
        "again": [(u, "q", 0), (u, "q", 0), ("USER", "q", 0), (a, "x", 1)],
        "blank": [(u, " ", 0), (a, None, 1)],
        "nullseq": [(u, "q", None), (a, "x", 1)],
        "tie": [(u, "q", 0), (u, "r", 0), (a, "x", 1)],
        "gap": [(u, "q", 0), (a, "x", 2)],
        "tool": [(u, "q", 0), ("tool", "x", 1)],
        "norole": [(u, "q", 0), (None, "x", 1)],
        "latesys": [(u, "q", 0), (s, "x", 1), (a, "y", 2)],
        "onlysys": [(s, "x", 0)],
        "asst": [(a, "x", 0), (u, "q", 1), (a, "y", 2)],
        "twice": [(u, "q", 0), (a, "x", 1), (a, "y", 2)],
        "open": [(u, "q", 0), (a, "x", 1), (u, "r", 2)],
        "hollow": [(u, "q", 0), (a, "  ", 1)],
        "double": [(u, "q", 0), (u, "r", 1), (a, "x", 2)],
        "unknown": [(u, "q", 0), (a, "x", 1)],
        None: [(u, "q", 0)],
    }
    rows = [(100 * k + n, name, *row) for k, (name, part) in enumerate(talks.items()) for n, row in enumerate(part)]
    placed, verdict = judge(spark, rows, [*(x for x in talks if x not in ("unknown", None)), "silent", "ok", None])
    got = {r.session_id: r.fault for r in verdict.collect()}
    broken = ("nullseq", "tie", "gap", "tool", "norole", "latesys", "onlysys", "asst", "twice", "unknown")
    assert got == {"ok": None, "again": None, "blank": "empty", "silent": "empty", "open": "no_reply", "hollow": "no_reply", "double": "no_reply"} | dict.fromkeys(broken, "broken")
    turns = [(r.session_id, r.turn, r.role, r.content) for r in conversations(placed, verdict).orderBy("session_id", "turn").collect()]
    assert turns == [("again", 0, u, "q"), ("again", 1, a, "x"), ("ok", 0, s, "be"), ("ok", 1, u, "q"), ("ok", 2, a, "a")]


def test_reply_links_bring_lost_rows_home(spark):
    rows = [(1, "s", "user", "q", 0), (2, None, "assistant", "a", 1), (3, None, "user", "x", 0)]
    links = spark.createDataFrame([(2, 1)], "a long, b long")
    _, verdict = judge(spark, rows, ["s"], links)
    assert [(r.session_id, r.fault) for r in verdict.collect()] == [("s", None)]


def test_nothing(spark):
    assert judge(spark, [], [])[1].count() == 0


def test_one_session_with_a_third_of_all_rows(spark):
    rows = [(n, "big", "user" if n % 2 == 0 else "assistant", f"t{n}", n) for n in range(1000)] + [(5000 + n, f"s{n // 2}", ("user", "assistant")[n % 2], "t", n % 2) for n in range(600)]
    _, verdict = judge(spark, rows, ["big", *(f"s{n}" for n in range(300))])
    assert verdict.where("fault is null").count() == 301


def test_the_answer_comes_from_the_components(spark, monkeypatch):
    rows = [(1, "s", "user", "q", 4), (2, "s", "assistant", "a", 5), (3, "s", "assistant", "a", 5)]
    assert judge(spark, rows, ["s"])[1].first().fault is None
    monkeypatch.setattr(module, "components", lambda links, a, b: links.select(links[a].alias("node"), links[b].alias("component")).limit(0))
    assert judge(spark, rows, ["s"])[1].first().fault == "broken"


def test_a_quote_joins_two_sessions(spark):
    rows = [(1, "a", "user", "q", 0), (2, "b", "assistant", "x", 1)]
    links = spark.createDataFrame([(2, 1)], "a long, b long")
    got = {r.session_id: r.fault for r in judge(spark, rows, ["a", "b"], links)[1].collect()}
    assert got == {"a": None, "b": "empty"}
