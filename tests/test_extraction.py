from pyspark.sql import functions as F

from graphloom.functions import source
from graphloom.operators.incremental import calibration
from graphloom.sources.extraction import completeness, frames, parse

ONE = """{"programId": "pay1", "executionMode": "BATCH", "copyReferences": ["cb1", "CB1", null, " "], "callTargets": [{"target": "sub1", "isDynamic": true}, {"target": "", "isDynamic": false}, {"target": "SUB2"}],
 "paragraphs": ["MAIN"], "dataItems": [{"name": "A", "level": 1}, {"name": "B", "level": 5, "picture": "X(3)"}], "dbTables": [{"name": "T", "schema": "S", "columns": ["c"], "operations": ["SELECT"]}]}"""


def docs(spark, *rows):
    return spark.createDataFrame(rows, "key string, program string, json string")


def test_structure(spark):
    parsed = parse(docs(spark, ("f1", None, ONE), ("f2", "P2", '```json\n{"paragraphs": ["X", "Y"'), ("f3", None, "prose"), (None, None, ONE), ("f4", None, None)), "structure")
    assert {(r.key, r.program, r.partial) for r in parsed.collect()} == {("f1", "PAY1", False), ("f2", "P2", True)}
    out = frames(parsed, "structure")
    assert {(r.src, r.dst, r.is_dynamic) for r in out["calls"].collect()} == {("PAY1", "SUB1", True), ("PAY1", "SUB2", False)}
    assert {r.copybook for r in out["includes"].collect()} == {"CB1"}
    assert {r.fqn for r in out["items"].collect()} == {"PAY1.01.A", "PAY1.05.B"}
    assert out["accesses"].first().operations == ["SELECT"] and {r.id for r in out["paragraphs"].collect()} == {"PAY1.MAIN", "P2.X", "P2.Y"}
    scores = completeness(parsed, spark.createDataFrame([("f1", 1000), ("f2", 10)], "key string, line_count int"))
    assert {r.key: r.score for r in scores.collect()} == {"f1": 0.8, "f2": 0.8}


def test_behaviour_job_estate_and_middleware(spark):
    b = frames(parse(docs(spark, ("f", "P", '{"fileOperations": [{"operation": "read", "fileName": "F1"}, {"operation": "OPEN", "fileName": "F2"}], "idmsOperations": [{"verb": "obtain", "record": "R"}], "performs": [{"fromParagraph": "A", "toParagraph": "B"}]}')), "behaviour"), "behaviour")
    assert {(r.file, r.type) for r in b["file_edges"].collect()} == {("F1", "READS"), ("F2", "WRITES")} and b["record_edges"].first().type == "NAVIGATES" and b["performs"].count() == 1
    j = frames(parse(docs(spark, ("j", None, '{"jobName": "J1", "steps": [{"pgm": "a", "ddCards": [{"ddName": "IN", "dsname": "X.Y", "isInput": true}]}, {"stepName": "S2", "pgm": "b"}]}')), "job"), "job")
    assert [(r.step, r.seq, r.program) for r in j["steps"].orderBy("seq").collect()] == [("STEP001", 1, "A"), ("S2", 2, "B")] and j["cards"].first().dsname == "X.Y"
    e = frames(parse(docs(spark, ("e", None, '{"domains": [{"name": "D", "programs": [{"programId": "P", "confidence": 0.5}, {"programId": null}]}], "copybookRisk": [{"copybook": "C", "riskLevel": "high"}]}')), "estate"), "estate")
    assert e["members"].collect()[0][1:] == ("D", "P", 0.5) and e["copybook_risks"].first().level == "HIGH"
    m = frames(parse(docs(spark, ("m", None, '{"entities": [{"name": ""}, {"name": "E", "properties": {"a": 1}}], "relationships": [{"fromEntity": "E", "toEntity": "F", "confidence": 0}]}')), "middleware"), "middleware")
    assert m["entities"].first().properties == {"a": "1"} and m["relations"].first().confidence == 0.5


def test_outlines_and_calibration(spark):
    df = spark.createDataFrame([("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. X1.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01  REC.\n       COPY BK.\n       PROCEDURE DIVISION.\n", "package a.b;\nimport c.d.E;\nimport c.d.F;\npublic class Q {\n  public int run(String s) { }\n}")], "p string, j string")
    r = df.select(source.preamble(F.col("p")), source.java_outline(F.col("j"))).first()
    assert r[0] == "PROGRAM-ID X1\nSECTION WORKING-STORAGE\n01 REC\nCOPY BK"
    assert r[1] == "package a.b\nimports c.d\npublic class Q\npublic int run(String s)"
    s = spark.createDataFrame([("k", 1, 10.0, 20.0), ("k", 2, 10.0, 10.0), ("k", 3, 0.0, 5.0), ("k", 4, 10.0, 40.0)], "k string, n int, e double, a double")
    assert [x.factor for x in calibration(s, "k", "n", "e", "a", last=3).orderBy("n").collect()] == [2.0, 1.5, 1.5, 2.5]
