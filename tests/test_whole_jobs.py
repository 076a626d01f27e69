"""Queries over small tables of their own, against what the rules say row by row."""

import datetime

from graphloom.plans import registry

PROGRAM = "program_id string, codebase string, file_path string, source_language string, line_count int, execution_mode string, is_external boolean, risk_score double, callees array<string>, copybooks array<string>, sql_tables array<string>, cics_commands array<string>, ingested_at timestamp_ntz, deleted_at timestamp_ntz"
DAY = datetime.datetime(2024, 1, 1)


def program(name, day=0, **other):
    row = dict.fromkeys(c.split()[0] for c in PROGRAM.split(", ")) | {"program_id": name, "file_path": f"{name}.cbl", "ingested_at": DAY + datetime.timedelta(days=day)} | other
    return tuple(row.values())


def ask(spark, folder, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return registry.queries()[name](spark, str(folder)).collect()


def test_a_change_in_any_column_is_a_change(spark, tmp_path):
    changes = {
        "codebase": "X", "file_path": None, "source_language": "ASM", "line_count": 9, "execution_mode": "CICS", "is_external": True, "risk_score": 0.5, "callees": ["A"],
        "copybooks": ["A", None], "sql_tables": [], "cics_commands": [None], "deleted_at": DAY,
    }
    rows = [x for c, v in changes.items() for x in (program(c), program(c, 1, **{c: v}))]
    rows += [program("same"), program("same", 1), program("once"), program("back", 0), program("back", 1, line_count=4), program("back", 2)]
    rows += [program("nulls", 0, copybooks=["A"]), program("nulls", 1, copybooks=["A", None]), program("parts", 0, callees=["A,B"]), program("parts", 1, callees=["A", "B"])]
    got = ask(spark, tmp_path, "inc02_changed", programs=(rows, PROGRAM))
    assert sorted(r.program_id for r in got) == sorted([*changes, "nulls", "parts"])


CALLS = "program_id string, target string, from_paragraph string, is_dynamic boolean"


def test_paths_and_impact_reach_five_hops(spark, tmp_path):
    pairs = {(f"P{n}", f"P{n + 1}") for n in range(7)} | {("P6", "P4"), ("Q", "P1"), ("Q", "Q"), ("P0", "P2")}
    names = sorted({x for pair in pairs for x in pair} | {"LONE"})
    books = {"P0": ["A", "B"], "P7": ["b.cpy", "C"], "Q": ["C", None], "LONE": ["D"]}
    card = lambda p, *files: "".join([f"//S EXEC PGM={p}\n", *[f"//DD1 DD DSN={x},DISP=SHR\n" for x in files]])
    texts = [card("P0", "F.ONE", "F.TWO") + card("Q", "F.TWO"), card("P7", "F.ONE") + card("GONE", "F.NONE"), "//DD0 DD DSN=F.LOOSE\n" + card("LONE", "F.OWN", "F.OWN"), None]
    tables = {
        "programs": ([program(n, copybooks=books.get(n)) for n in names], PROGRAM),
        "call_targets": ([(a, b, None, False) for a, b in pairs] + [("P0", "UNKNOWN", None, False)], CALLS),
        "documents": (list(enumerate(texts)), "doc_id long, text string"),
    }

    def met(start, hops):
        level, out = {(start,)}, {}
        for _ in range(hops):
            level = {(*p, b) for p in level for a, b in pairs if a == p[-1]}
            for p in sorted(level, key=lambda p: (len(p), p)):
                out.setdefault(p[-1], p)
        return out

    down = {n: met(n, 5) for n in names}
    got = {r.program: r for r in ask(spark, tmp_path, "pth02_impact", **tables)}
    assert sorted(got) == names
    for n in names:
        r, up = got[n], [m for m in names if n in down[m]]
        assert (r.downstream, r.upstream, r.down, r.up, r.total) == (",".join(sorted(down[n])), ",".join(up), len(down[n]), len(up), len(down[n]) + len(up))
    assert {n: (r.shared_copybooks, r.shared_files) for n, r in got.items() if r.shared_copybooks or r.shared_files} == {"P0": ("B", "F.ONE,F.TWO"), "P7": ("B,C", "F.ONE"), "Q": ("C", "F.TWO")}
    paths = registry.queries()["pth06_shortest_path"](spark, str(tmp_path)).collect()
    assert {(r.program, r.callee): r.path for r in paths} == {(n, m): " > ".join(p) for n in names for m, p in down[n].items() if m != n} and max(r.path.count(">") for r in paths) == 5
    chain = registry.queries()["pth01_call_chain"](spark, str(tmp_path)).collect()
    want = {(n, m, len(p) - 1) for n in names for m, p in met(n, 3).items() if m != n}
    assert {(r.program, r.other, r.depth) for r in chain if r.direction == "downstream"} == want
    assert {(r.other, r.program, r.depth) for r in chain if r.direction == "upstream"} == want and len(chain) == 2 * len(want)


def test_what_a_job_runs_is_not_dead(spark, tmp_path):
    gone = {"deleted_at": DAY}
    rows = [program("A"), program("CALLED", **gone), program("CB::RUN", **gone), program("IDLE", **gone), program("BARE", file_path=None), program("BELOW", **gone), program("BOTH", **gone)]
    got = ask(
        spark, tmp_path, "mut03_revive", programs=(rows, PROGRAM), call_targets=([("A", "CALLED", None, False), ("BARE", "BELOW", None, False), ("A", "BOTH", None, False)], CALLS),
        documents=([(1, "//S1 EXEC PGM=RUN\n//S2 EXEC PGM=BOTH\n//S3 EXEC PGM=NONE"), (2, "//S1 EXEC PGM=RUN"), (3, None), (4, "IDLE")], "doc_id long, text string"),
        orders=([], "o_orderkey long, o_orderpriority string"), lineitem=([], "l_orderkey long, l_linenumber int, l_partkey long"),
    )
    assert {r.id: r.dead for r in got} == {"A": False, "CALLED": False, "CB::RUN": False, "IDLE": True, "BARE": False, "BELOW": True, "BOTH": False} and len(got) == 7


def test_tags_are_stripped_whatever_the_line_ends(spark, tmp_path):
    texts = ["<b>a</b>\r\n<i>b</i>\r\n", " \t x <br\nclass='y'> z\x85\r", "kept <b>bold</b> then <i unclosed and all the rest", "a > b", "<a<b>c>d", "\r\r", "", "no tags", None, "<only", "x\r<y\r>z\n\n"]
    got = ask(spark, tmp_path, "src25_strip_tags", bw_chunks=([(n, "f.md", t, 0, 1) for n, t in enumerate(texts)], "chunk_id long, file_name string, content string, chunk_index int, chunk_total int"))

    def stripped(text):
        out, inside = "", False
        for c in text:
            inside = c == "<" or inside and c != ">"
            out += "" if inside or c == ">" else c
        return out.strip()

    assert {r.chunk_id: r.text for r in got} == {n: stripped(t) for n, t in enumerate(texts) if t is not None}


def test_queues_flow_between_different_programs(spark, tmp_path):
    uses = {(1, "q", "WRITE"), (2, "q", "READ"), (2, "q", "WRITE"), (3, "q", "READ"), (4, "alone", "READ"), (4, "alone", "WRITE"), (5, "unread", "WRITE"), (6, "mixed", "WRITE"), (6, "mixed", "READ"), (7, "mixed", "READ"), (None, "unread", "READ"), (8, None, "READ"), (9, None, "WRITE")}
    rows = [(p, q, 90.0 if way == "WRITE" else 10.0) for p, q, way in uses for _ in range(2)]
    got = ask(spark, tmp_path, "joi05_queue_flows", events=(rows, "user_id long, event_type string, value double"), programs=([], PROGRAM))
    flows = {(q, a, b) for a, q, w in uses for b, p, r in uses if q and q == p and w == "WRITE" and r == "READ" and a and b and a != b}
    ends = {(q, a, "writer") for q, a, _ in flows} | {(q, b, "reader") for q, _, b in flows}
    count = lambda q, way: len({p for p, x, w in uses if x == q and w == way and p})
    assert sorted(map(tuple, got)) == sorted((q, p, side, count(q, "WRITE"), count(q, "READ")) for q, p, side in ends)


def test_every_business_domain_has_its_programs(spark, tmp_path):
    got = ask(spark, tmp_path, "lst23_business_domain", programs=([program(n) for n in ("ABCX", "ABDX", "CBCX")] + [program("OUT", is_external=True)], PROGRAM))
    assert {r.domain: r.programs for r in got} == {"letter A": "ABCX,ABDX", "letter C": "CBCX", "kind BC": "ABCX,CBCX", "kind BD": "ABDX"}


def without_broadcast(spark, folder, name, **tables):
    """As ask(), where any table that the driver broadcasts is one too large."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        return ask(spark, folder, name, **tables)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


PARTS = {"part": ([(k,) for k in range(40)], "p_partkey long"), "programs": ([], PROGRAM)}


def dead_of(program):
    leads = {i: (i * i + program) % 10 for i in range(10)}
    met = entries = set(range(10)) - set(leads.values())
    for _ in range(10):
        met = met | {leads[i] for i in met}
    return sorted(set(range(10)) - met) if entries else []


DEAD = [(p, i) for p in range(40) for i in dead_of(p)]


def test_dead_paragraphs_need_no_broadcast(spark, tmp_path):
    assert DEAD
    assert sorted(map(tuple, without_broadcast(spark, tmp_path, "pth04_dead_paragraphs", **PARTS))) == DEAD


def test_first_dead_paragraphs_need_no_broadcast(spark, tmp_path):
    tables = PARTS | {"part": ([(k,) for k in reversed(range(300))], "p_partkey long")}
    want = [(p, i) for p in range(300) for i in dead_of(p)]
    assert len(want) > 100 and list(map(tuple, without_broadcast(spark, tmp_path, "nq16_dead_paragraphs", **tables))) == want[:100]


def test_dead_code_summary_needs_no_broadcast(spark, tmp_path):
    want = sorted(((p, 10, n) for p in range(40) if (n := len(dead_of(p)))), key=lambda r: (-r[2], r[0]))
    assert list(map(tuple, without_broadcast(spark, tmp_path, "agg05_dead_code_summary", **PARTS))) == want


def test_dead_by_domain_needs_no_broadcast(spark, tmp_path):
    names = {}
    for p, i in DEAD:
        shared = [f"A{p % 8}", *([f"B{p % 8}"] if p % 10 < 9 else []), f"C{p % 8 if p // 8 % 2 == 0 else (p + 7) % 8}"]
        for d in shared:
            names.setdefault(d, []).append(f"{p}.{i}")
    want = sorted((d, len(x), ",".join(sorted(x)[:5])) for d, x in names.items())
    assert sorted(map(tuple, without_broadcast(spark, tmp_path, "nq09_dead_by_domain", **PARTS))) == want
