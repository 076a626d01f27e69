from graphloom.llm.splitting import split

SCHEMA = "chunk_id long, content string, file_name string, chunk_index int, p string, l int"


def pieces(spark, texts, limit=10, ext="md"):
    df = spark.createDataFrame([(k, t, f"x.{ext}", 0, "p", 1) for k, t in enumerate(texts)], SCHEMA)
    out = {}
    for r in split(df, "chunk_id", "content", "file_name", limit=limit).orderBy("chunk_id", "chunk_index").collect():
        out.setdefault(r.chunk_id, []).append(r)
    return out


def test_pieces_keep_the_limit_and_the_text(spark):
    texts = ["a" * 200, "äöü€𝄞" * 40, "\n".join(f"line {n}" for n in range(60)), ("# h\n\n" + "word " * 9 + "\n\n") * 9, "x\r\ny\r\n\r\n" * 40, None, "", "short", " \t\n" * 50, "𝄞" * 60 + "\nq\n" * 9]
    got = pieces(spark, texts, limit=20)
    assert set(got) == {0, 1, 2, 3, 4, 9}
    for k, rows in got.items():
        raw, at = b"", 0
        for n, r in enumerate(rows):
            assert (r.chunk_index, r.chunk_total, r.from_byte) == (n, len(rows), at)
            assert len(r.content.encode()) * 10 // 32 <= 20
            at = r.to_byte
        assert {r.hard_cut for r in rows} == {int(any(len(x.encode()) * 10 // 32 > 20 for x in texts[k].split("\n")))}


def test_overlap_is_the_last_three_lines(spark):
    text = "\n".join(f"line number {n:02d}" for n in range(100))
    rows = pieces(spark, [text], limit=60)[0]
    for before, after in zip(rows, rows[1:]):
        assert after.content.split("\n")[:3] == before.content.split("\n")[-3:]
    tidy = text.encode()
    assert b"".join(tidy[r.from_byte : r.to_byte] for r in rows) == tidy


def test_strong_boundaries_first(spark):
    text = "intro line here\n\n" + "# Head\n" + "body text one\nbody text two\n\n" + "para two text\n" * 6
    rows = pieces(spark, [text], limit=40)[0]
    assert rows[0].content == "intro line here"
    assert rows[1].content.endswith("body text two")


def test_a_line_as_long_as_a_piece_stays_whole(spark):
    rows = pieces(spark, ["a" * 32 + "\n" + "b" * 33 + "\n" + "c" * 34], limit=10)[0]
    assert "b" * 33 in [r.content for r in rows] and {r.hard_cut for r in rows} == {0}


def test_a_very_long_text_and_an_empty_table(spark):
    rows = pieces(spark, ["word " * 200_000 + "\n" + "z\n" * 100_000], limit=1000)[0]
    assert rows[-1].to_byte == len(("word " * 200_000).rstrip() + "\n" + "z\n" * 100_000)
    assert pieces(spark, []) == {}


def test_hard_cuts_come_from_the_pattern(spark, monkeypatch):
    from pyspark.sql import functions as F

    from graphloom.llm import splitting

    text = "\n".join(f"line number {n:02d}" for n in range(100))
    assert {r.hard_cut for r in pieces(spark, [text], limit=60)[0]} == {0}
    monkeypatch.setattr(splitting, "_pattern", lambda *_: F.lit("(?s).{1,5}"))
    assert {r.hard_cut for r in pieces(spark, [text], limit=60)[0]} == {1}
