from pyspark.sql import functions as F

from graphloom.functions import chunks, classify
from graphloom.operators.fuzzy import containing_pairs
from graphloom.operators.incremental import cached, load_results, store_results
from graphloom.sources.extraction import behaviour_score, estate_score, frames, merged, parse

DOCS = "key string, program string, json string"


def test_repair_documents(spark):
    text = """{"childOfRelationships": [{"child": "a", "childLevel": 5, "parent": "B", "parentLevel": 1}, {"child": "", "parent": "X"}, {"child": "c", "parent": ""}],
      "dataFlows": [{"fromItem": "x", "toItem": "y", "context": "MOVE"}, {"fromItem": "x"}], "calls": [{"target": "sub", "fromParagraph": "M"}, {"target": ""}], "annotations": [{"paragraph": ""}, {"paragraph": "P", "description": "d"}],
      "verifications": [{"paragraphName": "P", "verdict": "false_positive"}, {"paragraphName": "Q", "verdict": "confirmed_dead"}], "decisions": [{"domain1": "A", "domain2": "B", "action": "merge", "keepDomain": "A"}, {"domain1": "C", "domain2": "D", "action": "keep_separate"}]}"""
    out = frames(parse(spark.createDataFrame([("f", "P1", text)], DOCS), "repair"), "repair")
    assert [(r.src, r.dst) for r in out["children"].collect()] == [("P1.05.A", "P1.01.B")]
    assert [(r.src, r.dst, r.context) for r in out["moves"].collect()] == [("P1.X", "P1.Y", "MOVE")]
    assert [(r.dst, r.is_dynamic) for r in out["calls"].collect()] == [("SUB", False)]
    assert [r.paragraph for r in out["annotations"].collect()] == ["P"]
    assert {r.paragraph: r.false_positive for r in out["verdicts"].collect()} == {"P": True, "Q": False}
    assert {(r.a, r.merge) for r in out["merges"].collect()} == {("A", True), ("C", False)}


def test_middleware_links_and_external_and_target_documents(spark):
    links = """{"newCobolReferences": [{"entityMergeId": "e", "targetName": "T", "confidence": 0}, {"entityMergeId": "e", "targetName": ""}], "crossFileRelationships": [{"fromMergeId": "a", "toMergeId": "b"}, {"fromMergeId": "a"}],
      "clusters": [{"name": "c", "entityMergeIds": ["x"]}, {"name": "d", "entityMergeIds": []}], "repairs": [{"entityMergeId": "e", "action": "reject"}, {"entityMergeId": "f", "action": "confirm", "confidence": 0.9}]}"""
    out = frames(parse(spark.createDataFrame([("f", None, links)], DOCS), "middleware_links"), "middleware_links")
    assert [(r.entity, r.confidence) for r in out["references"].collect()] == [("e", 0.5)] and out["relations"].count() == 1
    assert [r.name for r in out["clusters"].collect()] == ["c"] and [(r.entity, r.confidence) for r in out["repairs"].collect()] == [("f", 0.9)]
    ext = """```json\n{"externalTables": [{"name": "Cust", "schema": "Core", "columns": [{"name": "ID", "isPK": true}]}], "mappings": [{"cobolTable": "CUST", "externalTable": "Cust", "confidence": 0.8, "columnMappings": [{"cobolColumn": "A", "externalColumn": "B"}]}], "gaps": [{"side": "cobol", "tableName": "X"}], "dataFlows": [{"cobolProgram": "P"}]}\n```"""
    e = frames(parse(spark.createDataFrame([("Ora", None, ext)], DOCS), "external"), "external")
    assert e["tables"].first().id == "ora.core.cust" and e["mappings"].first().columns[0].externalColumn == "B" and e["gaps"].count() == e["flows"].count() == 1
    target = """{"services": [{"name": "S", "serviceType": "http"}, {"name": ""}], "rules": [{"name": "R", "confidence": 0.4, "serviceName": "S"}, {"name": "Q", "confidence": 0.7, "category": "calc", "serviceName": "S"}], "endpoints": [{"method": "get", "path": "/a", "serviceName": "S"}]}"""
    t = frames(parse(spark.createDataFrame([("repo", None, target)], DOCS), "target"), "target")
    assert [(r.id, r.type) for r in t["services"].collect()] == [("repo::S", "REST_API")] and [(r.id, r.category) for r in t["rules"].collect()] == [("repo::S::Q", "CALCULATION")]
    assert [(r.id, r.method) for r in t["endpoints"].collect()] == [("repo::S::get::/a", "GET")]


def test_chunks_merge_and_scores(spark):
    one = '{"performs": [{"fromParagraph": "A", "toParagraph": "B"}], "annotations": [{"paragraph": "A", "description": "main logic"}], "errorHandling": [{"paragraph": "A", "pattern": "one"}]}'
    two = '{"performs": [{"fromParagraph": "A", "toParagraph": "B"}, {"fromParagraph": "B", "toParagraph": "ZZ"}], "annotations": [{"paragraph": "A", "description": "checks the claim and its date"}], "errorHandling": [{"paragraph": "A", "pattern": "two"}]}'
    parsed = parse(spark.createDataFrame([("c1", "P", one), ("c2", "P", two)], DOCS), "behaviour")
    out = merged(frames(parsed, "behaviour"))
    assert out["performs"].count() == 2 and [r.description for r in out["annotations"].collect()] == ["checks the claim and its date"] and [r.pattern for r in out["handlers"].collect()] == ["one"]
    known = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "A"), ("c2", "B")], "key string, name string")
    assert {r.key: r.score for r in behaviour_score(parsed, known).collect()} == {"c1": 0.98, "c2": 0.99}
    part = lambda n: spark.createDataFrame([(f"p{i}",) for i in range(n)], "program string")
    assert round(estate_score({"members": part(5), "risks": part(10), "volumes": part(1)}, 10), 6) == 0.65
    assert estate_score({"members": part(0), "risks": part(0), "volumes": part(0)}, 0) == 1.0


def test_containing_pairs_agree_with_brute_force(spark):
    a = ["JOURNALENTRY", "ABC", "ENTRY", "XENTRYX", None, "", "JOUR"]
    b = ["WSJOURNALENTRYKEY", "ENTRY", "TRYX", "LONGENTRY", None, "AB"]
    got = containing_pairs(spark.createDataFrame([(x, x, 1) for x in a], "n string, t string, g int"), spark.createDataFrame([(x, x, 1) for x in b + b], "f string, t string, l int"), "n", "f", "t").collect()
    assert sorted((r.n, r.f) for r in got) == sorted((x, y) for x in a for y in b if x and y and len(x) >= 4 and len(y) >= 4 and (x in y or y in x))


def test_cache_of_classes_and_results(spark):
    store = spark.createDataFrame([("a", "h1", "COBOL", 0.9), ("b", "old", "JCL", 0.8)], "path string, hash string, kind string, confidence double")
    hits, misses = cached(spark.createDataFrame([("a", "h1"), ("b", "new"), ("c", None)], "path string, hash string"), store)
    assert [(r.path, r.kind) for r in hits.collect()] == [("a", "COBOL")] and {r.path for r in misses.collect()} == {"b", "c"}
    rows = "path string, pass int, chunk int, total int, hash string, result string"
    kept = store_results(spark.createDataFrame([("a", 1, 1, 2, "h", "old"), ("a", 1, 0, 2, "h", "x")], rows), spark.createDataFrame([("a", 1, 1, 2, "h", "new"), ("a", 2, 0, 1, "h", "y")], rows))
    assert [r.result for r in load_results(kept, "a", 1).collect()] == ["x", "new"] and kept.count() == 3


def test_units_and_ladder():
    data = "       DATA DIVISION.\n       FILE SECTION.\n       FD  F1.\n       01  R1.\n           05 A PIC X.\n       WORKING-STORAGE SECTION.\n       01  R2."
    assert [u.strip().split("\n")[0].strip() for u in chunks.data_units(data)] == ["DATA DIVISION.", "FILE SECTION.", "FD  F1.", "01  R1.", "WORKING-STORAGE SECTION.", "01  R2."]
    text = "\n".join(f"           MOVE A{n} TO B{n}." for n in range(40))
    parts = chunks.oversized("P", text, 50)
    assert [n for n, _ in parts][:2] == ["P.part1", "P.part2"] and "\n".join(t for _, t in parts) == text and all(chunks.tokens(t) <= 50 * 1.1 for _, t in parts)
    bare = "\n".join(f"           MOVE A{n} TO B{n}" for n in range(40))
    assert len(chunks.oversized("P", bare, 50)) > 1 and chunks.oversized("P", "x", 50) == [("P", "x")]
    whole = chunks.chunked(data, [("P", text), ("Q", bare)], "PREAMBLE", 100)
    assert whole[0].startswith("PREAMBLE") and sum(c.count("PREAMBLE") for c in whole) == 1 and all(chunks.tokens(c) <= 110 for c in whole)
    assert chunks.chunked(None, [], "", 10) == []


def test_texts_for_readers_and_repositories(spark):
    df = spark.createDataFrame([("äöü€ long text " * 20, "# A\nprose\n- item\n  CALL X\n" + "prose " * 60, "<<1>>\none\n<<2>>\ntwo\n<<3>>\nthree")], "a string, b string, c string")
    r = df.select(chunks.truncated(F.col("a"), 8), chunks.outline(F.col("b"), 60), chunks.marked_sections(F.col("c"), ["<<1>>", "<<2>>", "<<3>>", "<<4>>"]), chunks.marked_sections(F.col("c"), ["<<1>>", "<<9>>"])).first()
    assert r[0] == "äöü..." and r[1] == "# A\n- item\nCALL X" and [(x.marker, x.content.strip()) for x in r[2]] == [("<<1>>", "one"), ("<<2>>", "two"), ("<<3>>", "three")] and r[3] is None
    paths = spark.createDataFrame([("src/test/A.java",), ("api/x.proto",), ("pom.xml",), ("conf/a.yml",), ("src/A.java",), ("src/B.py",), ("src/C.java",), ("notes.bin",), (None,)], "p string")
    assert [x[0] for x in paths.select(classify.repo_category(F.col("p"))).collect()][:8] == ["test", "schema", "build", "config", "source", "source", "source", "other"]
    assert classify.primary_language(paths, "p").first()[0] == "Java" and classify.primary_language(paths.limit(0), "p").count() == 0
    u = spark.createDataFrame([("https://github.com/o/repo.git",), ("https://dev.azure.com/o/p/",), ("nothing",)], "u string")
    assert [tuple(x) for x in u.select(classify.repo_provider(F.col("u")), classify.repo_name(F.col("u"))).collect()] == [("github", "repo"), ("azure_devops", "p"), ("generic", "nothing")]
    assert [x[0] for x in spark.createDataFrame([("x @startMindMap",), ("none",)], "t string").select(classify.plantuml_kind(F.col("t"))).collect()] == ["Mind Map", ""]
    assert [x[0] for x in spark.createDataFrame([("META-INF/MANIFEST.MF",), ("a/b.class",), ("c.png",)], "t string").select(classify.analyzable(F.col("t"))).collect()] == [True, True, False]


def test_every_tool_has_its_query(spark):
    from graphloom.plans import registry, tools

    known = registry.queries()
    assert {q for q, _ in tools.TOOLS.values()} <= set(known)
    rows = tools.call(spark, "/root/testdata/sf0.001", "get_queue_flows", "no such queue")
    assert rows.count() == 0 and rows.columns[0] == "queue"


def test_queue_ends(spark):
    from graphloom.plans.answers import queue_ends

    rows = [("a", "MQPUT ('Q1')"), ("a", "MQPUT ('Q1')"), ("b", "MQGET ('Q1')"), ("c", "MQOPEN OUTPUT ('Q2')"), ("c", "MQOPEN INPUT ('Q2')"), ("d", "MQCLOSE ('Q1')"), (None, "MQGET ('Q2')"), ("e", None), ("f", "MQPUT")]
    df = spark.createDataFrame(rows, "program string, details string")
    assert {tuple(r) for r in queue_ends(df).collect()} == {("Q1", "a", "writer", 1, 1), ("Q1", "b", "reader", 1, 1)}
    assert queue_ends(df.limit(0)).count() == 0


def test_listing_pages(spark):
    from graphloom.plans.answers import lst01_programs, lst02_program_detail

    sf = "/root/testdata/sf0.001"
    whole = [r.id for r in lst01_programs(spark, sf).collect()]
    page = lst01_programs(spark, sf, page=2, size=5).collect()
    assert [r.id for r in page] == whole[5:10] and page[0].total == len(whole)
    part = lst01_programs(spark, sf, contains="::").collect()
    assert part and all("::" in r.id and r.total == len(part) for r in part)
    assert lst02_program_detail(spark, sf, whole[0]).count() == 1 and lst02_program_detail(spark, sf, "none").count() == 0
