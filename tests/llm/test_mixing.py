import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing


def frames(spark, n=400):
    rows = [(k, ("a", "b", "c", "zz", None)[k % 5] if k % 3 else "a", "t" * 32 * (1 + k % 7), 1, 2) for k in range(n)] + [(9001, "a", None, 1, 2), (9002, "b", "", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string, copies int")
    targets = spark.createDataFrame([("a", 0.2, 1, 5), ("b", 0.35, 4, 5), ("c", 0.4, 2, 5), ("gone", 0.05, 3, 5), (None, 0.1, 1, 5)], "source string, target_share double, max_repeats int, tokens int")
    return docs, targets


def test_budgets_are_cut_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    docs, targets = frames(spark)
    sized = mixing.sized(docs, vocabulary=None)
    plan = mixing.budgets(sized, targets)
    mixed = mixing.mix(sized, plan)
    sizes = {r.doc_id: r["size"] for r in sized.collect()}
    most = max(sizes.values())
    got = {r.source: r for r in mixing.shares(mixed, plan).collect()}
    assert set(got) == {"a", "b", "c", "gone"} and got["gone"].taken == 0 and got["gone"].short
    for s in ("a", "b", "c"):
        assert got[s].taken <= got[s].budget
        if not got[s].short:
            assert got[s].budget - got[s].taken < most
        else:
            assert got[s].taken == got[s].tokens * got[s].max_repeats
    uses = mixing.repeated(mixed).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("epoch").alias("e"), F.first("source").alias("s")).collect()
    assert all(r.n == r.e <= got[r.s].max_repeats for r in uses)
    assert mixed.orderBy("doc_id").collect() == mixing.mix(sized, plan).orderBy("doc_id").collect()


def test_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    texts = ["Hello world", "", None, "MOVE TB-RECORD-CODE  TO\n\n  X'1'.", "Übergabebereich zählt 12 <|endoftext|>", "aaaa" * 300]
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]
    df = spark.createDataFrame([(k, "s", x) for k, x in enumerate(texts)], "doc_id long, source string, text string")
    assert [r["size"] for r in mixing.sized(df).orderBy("doc_id").collect()] == want


def test_nothing(spark):
    docs, targets = frames(spark)
    sized = mixing.sized(docs.limit(0), vocabulary=None)
    plan = mixing.budgets(sized, targets)
    assert mixing.mix(sized, plan).count() == 0 and mixing.shares(mixing.mix(sized, plan), plan).count() == 4
    assert mixing.budgets(mixing.sized(docs, None), targets.limit(0)).count() == 0


def test_short_is_read_off_the_mix(spark):
    docs, targets = frames(spark)
    sized = mixing.sized(docs, vocabulary=None)
    plan = mixing.budgets(sized, targets)
    mixed = mixing.mix(sized, plan)
    short = lambda m: {r.source for r in mixing.shares(m, plan).where("short").collect()}
    assert short(mixed) == {"c", "gone"} and short(mixed.where("source <> 'c' or doc_id % 7 = 0")) == {"gone"}
