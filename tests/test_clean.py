from pyspark.sql import functions as F

from graphloom.functions import clean


def one(spark, f, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_copybooks(spark):
    assert one(spark, clean.copybook, ["stdhdr01", " Cwk1.cpy ", "A OF PRODLIB", "", "  ", None, "\tX"]) == ["STDHDR01", "CWK1", "A", None, None, None, "X"]


def test_targets(spark):
    got = one(spark, clean.target, [" 'Nrp00060 '", '"X1".', "retail::abc", "'default::q'", " . ", None, "A B"])
    assert got == ["NRP00060", "X1", "ABC", "Q", None, None, "A B"]


def test_sources_names_and_tokens(spark):
    assert one(spark, clean.source, [" Chat-Answer", None, " "]) == ["chat_answer", None, None]
    assert one(spark, clean.name, [" t.x ", "", None]) == ["T.X", None, None]
    assert one(spark, clean.tokens, ["abcd", "é" * 8, "", None]) == [1, 5, 0, 0]
    assert one(spark, clean.codebase_of, ["a::b", "b"]) == ["a", "default"]
