import base64
import io
import struct
import time
import urllib.parse
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.operators import adhoc
from graphloom.plans import tools
from graphloom.plans.dialect import duck_sql, spark_sql
from graphloom.sources import files, sinks
from graphloom.streaming import streams


def archive(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return b.getvalue()


def test_directory_scan_and_archives(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.cbl").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.CBL").write_text("one\ntwo\n")
    (tmp_path / "B.CPY.txt").write_text("x")
    (tmp_path / "C").write_text("//A JOB X\n//B EXEC PGM=Q")
    (tmp_path / "e.dat").write_text("")
    (tmp_path / "z.jar").write_bytes(archive(a__txt=b"hi", in__war=archive(b__txt=b"deep", deeper__zip=archive(c__txt=b"x", no__jar=archive(d__txt=b"too deep")))))
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r["size"], r.line_count) for r in files.scan(spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in ("A.CBL", "B.CPY.txt", "C")} == {"A.CBL": ("COBOL", 8, 2), "B.CPY.txt": ("COPYBOOK", 1, 1), "C": ("JCL", 24, 2)} and not {"x.cbl", "e.dat"} & set(got)
    found = {r.path.rsplit("z.jar", 1)[1]: bytes(r.content) for r in files.archives(spark, str(tmp_path)).collect()}
    assert found == {"!/a.txt": b"hi", "!/in.war!/b.txt": b"deep", "!/in.war!/deeper.zip!/c.txt": b"x"}
    assert list(files.entries("x", b"not a zip")) == []


def class_file():
    utf = lambda s: b"\x01" + struct.pack(">H", len(s)) + s.encode()
    pool = [utf("a/b/Foo"), b"\x07\x00\x01", utf("java/lang/Object"), b"\x07\x00\x03", utf("run"), utf("(I[Ljava/lang/String;)V"), utf("n"), utf("J"), b"\x05" + bytes(8)]
    body = struct.pack(">H", len(pool) + 2) + b"".join(pool) + struct.pack(">HHHH", 1, 2, 4, 0)
    body += struct.pack(">H", 1) + struct.pack(">HHHH", 2, 7, 8, 0) + struct.pack(">H", 1) + struct.pack(">HHHH", 9, 5, 6, 0) + struct.pack(">H", 0)
    return b"\xca\xfe\xba\xbe" + b"\0\0\0\x34" + body


def test_class_files_and_descriptors():
    assert files.descriptor("([Ljava/lang/String;IJ)[[D") == ["String[]", "int", "long", "double[][]"]
    assert files.class_text(class_file()).split("\n") == ["public class a.b.Foo extends java.lang.Object", "  private long n", "  public static void run(int, String[])"]
    assert files.class_text(b"nope") is None


def test_diagrams(spark):
    model = '<mxGraphModel><root><mxCell id="1" value="&lt;b&gt;Pay&lt;/b&gt;" vertex="1"/><mxCell id="2" value="Ledger" vertex="1"/><mxCell id="3" edge="1" source="1" target="2" value="posts"/><mxCell id="4" edge="1" source="1" target="9"/></root></mxGraphModel>'
    deflate = zlib.compressobj(wbits=-15)
    packed = base64.b64encode(deflate.compress(urllib.parse.quote(model).encode()) + deflate.flush()).decode()
    want = "shape: Pay\nshape: Ledger\nPay -> Ledger: posts\nPay -> 9"
    assert files.drawio_text(f"<mxfile><diagram>{model}</diagram></mxfile>".encode()) == want
    assert files.drawio_text(f"<mxfile><diagram>{packed}</diagram></mxfile>".encode()) == want
    svg = b'<svg xmlns="http://www.w3.org/2000/svg"><title>T</title><g><text>a <tspan>b</tspan></text><text>a b</text></g></svg>'
    assert files.svg_text(svg) == "T\na b"
    page = b'<PageContents xmlns="x"><Shapes><Shape ID="1"><Text>A</Text></Shape><Shape ID="2"><Text>B</Text></Shape><Shape ID="3"/></Shapes><Connects><Connect FromSheet="3" FromCell="BeginX" ToSheet="1"/><Connect FromSheet="3" FromCell="EndX" ToSheet="2"/></Connects></PageContents>'
    assert files.visio_text(archive(**{"visio/pages/page1__xml": page})) == "shape: A\nshape: B\nA -> B"
    df = spark.createDataFrame([("a.svg", svg), ("b.svg", b"<bad"), ("c.txt", b"x"), ("d.puml", b"@startuml"), ("e.svg", None)], "path string, content binary")
    assert {r.path: r.text for r in files.texts_of(df).collect()} == {"a.svg": "T\na b", "d.puml": "@startuml"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.25), (None, None)], "k string, v double")
    sinks.csv(df.coalesce(1), str(tmp_path / "out"))
    assert [r.v for r in spark.read.csv(str(tmp_path / "out"), header=True).orderBy(F.col("v").desc_nulls_last()).collect()] == ["1.3", None]
    sinks.markdown([("Part", df)], str(tmp_path / "r.md"), rows=1)
    text = (tmp_path / "r.md").read_text()
    assert "| a\\|b | 1.25 |" in text and "More rows" in text


def test_adhoc(spark):
    spark.range(2000).createOrReplaceTempView("numbers")
    got = adhoc.ask(spark, "SELECT id FROM numbers ORDER BY id", 5)
    assert got.rows == [(0,), (1,), (2,), (3,), (4,)] and got.truncated and got.columns == ["id"]
    assert not adhoc.ask(spark, "SELECT id AS `offset` FROM numbers WHERE id < :n", 50, {"n": 3}).truncated
    for bad in ("DROP VIEW numbers", "CREATE TABLE t AS SELECT 1", "INSERT INTO numbers SELECT 1", "SET a=b", "CREATE TEMP VIEW v AS SELECT 1", "TRUNCATE TABLE numbers"):
        with pytest.raises(PermissionError):
            adhoc.ask(spark, bad)
    assert adhoc.clamp(0) == 100 and adhoc.clamp(5000) == 1000 and adhoc.page(0, 500) == (0, 20) and adhoc.page(3, 10) == (20, 10)
    assert adhoc.writes("MATCH (n) SET n.x = 1") and not adhoc.writes("MATCH (n) WHERE n.x = 'CREATE' /* DROP */ RETURN n.offset, n.`set`")


def test_tools_and_dialects(spark):
    from graphloom.plans import registry

    known = registry.queries()
    assert all(q in known for q, _ in tools.TOOLS.values())
    assert set(registry.oracle_sql()) <= set(known)
    assert len(tools.named_queries()) >= 15
    with pytest.raises(KeyError):
        tools.run_named(spark, "nowhere", "lst01_programs")
    assert spark_sql("SELECT DIV(BYTES(x) * 10, 32), TEXTS(a || ',')") == "SELECT ((CAST(octet_length(x) AS BIGINT) * 10) div (32)), array_join(array_sort(collect_set(CAST(a || ',' AS STRING))), ',')"
    assert "string_agg(DISTINCT" in duck_sql("SELECT TEXTS(a)")


def test_keyed_completion_stream(spark, tmp_path):
    schema = "file string, n int, total int, body string"
    for k, rows in enumerate([[("f", 0, 2, "x"), ("g", 0, 3, "x"), ("f", 0, 2, "x")], [("f", 1, 2, "x"), ("f", 1, 2, "x"), (None, 0, 1, "x"), ("h", 0, None, "x")], [("f", 0, 2, "again"), ("k", 0, 1, "x")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.completed(source, "file", "n", "total").writeStream.format("memory").queryName("done").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("done").collect()) == [("f", 2, "complete"), ("k", 1, "complete")]


def test_windows_with_a_watermark(spark, tmp_path):
    spark.sql("SELECT timestamp'2025-01-01 00:10:00' AS ts, 'a' AS kind, 1.5D AS value UNION ALL SELECT timestamp'2025-01-01 00:50:00', 'a', 2.0D UNION ALL SELECT timestamp'2025-01-01 03:00:00', 'b', 1.0D").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string, value double").parquet(str(tmp_path / "in"))
    q = streams.windowed(stream, "ts", "kind", "value").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.kind, r.n, r.total) for r in spark.table("windows").collect()) == [("a", 2, 3.5), ("b", 1, 1.0)]
