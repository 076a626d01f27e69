import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import classify, packing, source
from graphloom.functions.recover import recover


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{n} string" for n in range(len(values))))
    return df.select(f(*[F.col(f"c{n}") for n in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    "pic, usage, want",
    [
        ("PIC 9(5)", "", ("int", "INTEGER", "DISPLAY", 5)),
        ("S9(7)V99", "", ("BigDecimal", "DECIMAL(9,2)", "DISPLAY", 10)),
        ("S9(9)", "COMP-3", ("BigDecimal", "DECIMAL(9,0)", "PACKED_DECIMAL", 5)),
        ("S9(7)V99", " comp-3 ", ("BigDecimal", "DECIMAL(9,2)", "PACKED_DECIMAL", 5)),
        ("S9(4)", "COMP", ("short", "SMALLINT", "BINARY", 2)),
        ("9(18)", "COMP", ("long", "BIGINT", "BINARY", 8)),
        ("9(12)", "", ("long", "BIGINT", "DISPLAY", 12)),
        ("X(30)", "", ("String", "VARCHAR(30)", "DISPLAY", 30)),
        ("XX", "COMP", ("String", "VARCHAR(2)", "DISPLAY", 2)),
        ("A(9)", None, ("String", "VARCHAR(9)", "DISPLAY", 9)),
        ("99V9(3)", None, ("BigDecimal", "DECIMAL(5,3)", "DISPLAY", 5)),
    ],
)
def test_pic_types(spark, pic, usage, want):
    assert tuple(one(spark, source.pic_types, pic, usage)) == want


def test_empty_pic(spark):
    assert one(spark, source.pic_types, "", "COMP") is None and one(spark, source.pic_types, None, None) is None


def test_fuzzy_rungs(spark):
    got = lambda a, b: (lambda r: r and (round(r.score, 3), r.reason))(one(spark, source.fuzzy, a, b))
    assert got(" abcd ", "ABCD") == (1.0, "exact_match")
    assert got("CUSTOMERREC", "CUST") == (0.8, "substring_contains")
    assert got("CUSTOMER", "CUSTARDS") == (0.5, "shared_prefix")
    assert got("PAYMENTSERVICE", "PYMNT") == (0.7, "cobol_abbreviation")
    assert got("ABCDE", "XBCDE") == (0.8, "levenshtein")
    assert got("ABC", "XYZ") is None and got("", "A") is None and got(None, "A") is None


def test_columns_and_continuations(spark):
    assert one(spark, source.strip_sequence, "000100 MOVE A\nshort\n" + "1" * 6 + "x" * 80) == " MOVE A\nshort\n" + "x" * 66
    assert one(spark, source.join_continuations, "000100 MOVE 'AB   \n000200-    'CD'\nnext") == "000100 MOVE 'AB'CD'\nnext"


def test_divisions_and_paragraphs(spark):
    text = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. X.\n       DATA DIVISION.\n       01 A.\n       PROCEDURE DIVISION.\n           MOVE A TO B.\n       MAIN.\n           PERFORM Q.\n       Q SECTION.\n           GOBACK."
    assert "01 A" in one(spark, lambda c: source.division(c, "DATA"), text)
    assert one(spark, lambda c: source.division(c, "ENVIRONMENT"), text) is None
    assert one(spark, lambda c: source.division(c, "PROCEDURE"), "no headers") == "no headers"
    parts = one(spark, lambda c: source.paragraphs(source.division(c, "PROCEDURE")), text)
    assert [p.name for p in parts] == ["PREAMBLE", "MAIN", "Q"]


def test_small_texts(spark):
    assert one(spark, lambda c: source.snippet(c, 20), "\n".join(map(str, range(100)))).count("...") == 2
    assert one(spark, lambda c: source.snippet(c, 20), "a\nb") == "a\nb"
    assert one(spark, lambda c: source.blocks(c, "mermaid"), "x\n```mermaid\nA-->B\n```\n```py\n1\n```") == ["A-->B\n"]
    assert one(spark, lambda c: source.cap_list(F.split(c, " "), 3), "aaaa bbbb cccc dddd") == "aaaa, bbbb… and 2 more".replace("bbbb…", "bbbb, …")
    assert one(spark, source.abbreviate, "PAYMENTSERVICE") == "PYMNT"


def test_classifiers(spark):
    kind = lambda t: one(spark, classify.by_content, t)
    assert kind("//A JOB X\n//B EXEC PGM=C") == "JCL"
    assert kind("       PROGRAM-ID. A.") == "COBOL" and kind("MOVE A\nMOVE B\nPERFORM C") == "COBOL"
    assert kind("       05  A PIC X.\n") == "COPYBOOK" and kind("plain prose") is None and kind(None) is None
    assert [one(spark, classify.by_name, n) for n in ("a.CBL", "b.cpy.txt", "c.txt", "d")] == ["COBOL", "COPYBOOK", None, None]
    assert [one(spark, classify.name_hint, n) for n in ("CPYX.txt", "DCLA", "MAP1", "PROCA", "AB$1", "long-name-here")] == ["COPYBOOK", "DCLGEN", "BMS", "PROC", "MEMBER", None]
    assert one(spark, lambda c: classify.normal(c, "risk_type"), "HUB") == "hub" and one(spark, lambda c: classify.normal(c, "category"), None) == "OTHER"
    assert one(spark, lambda c: classify.synonym(c, "integration"), "kafka") == "MESSAGE_QUEUE" and one(spark, lambda c: classify.synonym(c, "service"), "?") == "REST_API"
    assert one(spark, classify.trim_comment_header, "* a\n\n  * b\nCODE\n* c") == "CODE\n* c" and one(spark, classify.trim_comment_header, "* a\n") == "* a\n"


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": [1, 2,]}\n```', {"a": [1, 2]}),
        ('Here: {"a": 1} Hope this helps!', {"a": 1}),
        ('{"a": "x // y", /* c */ "b": 2 // d\n}', {"a": "x // y", "b": 2}),
        ('{"a": [{"b": 1}, {"b": 2}, {"b"', {"a": [{"b": 1}, {"b": 2}, {}]}),
        ('{"a": ["one", "tw', {"a": ["one"]}),
        ('{"a": 1, "b":', {"a": 1}),
        ('{"a": [1, 2', {"a": [1, 2]}),
        ('[{"id": 1}, {"id"', [{"id": 1}, {}]),
        ("no json", None),
        ("", None),
        (None, None),
    ],
)
def test_json_recovery(raw, want):
    got = recover(raw)
    assert (json.loads(got) if got is not None else None) == want


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12), st.data())
def test_any_truncation_of_json_recovers(value, data):
    text = json.dumps({"k": value})
    cut = data.draw(st.integers(1, len(text)))
    got = recover(text[:cut])
    assert got is not None and isinstance(json.loads(got), dict)
    if cut == len(text):
        assert json.loads(got) == {"k": value}


def test_a_long_string_cut_off_costs_only_itself():
    cut = '{"gaps": [{"id": "G1", "title": "ok"}, {"id": "G2", "title": "' + "one of very many words, [so] {to} say: " * 40
    assert json.loads(recover(cut)) == {"gaps": [{"id": "G1", "title": "ok"}, {"id": "G2"}]}
    assert json.loads(recover('{"a": [1, 2], "b": ' + "x " * 50)) == {"a": [1, 2]}


def closed_at_any_place(text):
    """The longest valid JSON that ends with an element of the text, all its prefixes and closings tried."""
    for end in range(len(text), 0, -1):
        open_, quoted, escaped = [], False, False
        for c in text[:end]:
            if quoted:
                quoted, escaped = escaped or c != '"', c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{[":
                open_.append("}" if c == "{" else "]")
            elif c in "}]":
                open_.pop()
        try:
            return json.loads(text[:end] + "".join(reversed(open_)))
        except ValueError:
            continue
    return None


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.text(alphabet='ab "\\\\{}[],:/', max_size=60), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12), st.data())
def test_recovery_loses_no_element(value, data):
    text = json.dumps({"k": value})
    cut = text[: data.draw(st.integers(1, len(text)))]
    assert json.loads(recover(cut)) == closed_at_any_place(cut)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é\n#.", max_size=600), st.sampled_from(["md", "java", "txt", "cbl"]), st.integers(10, 40))
def test_packing_keeps_the_limit_and_all_words(text, kind, limit):
    got = packing.pack(text, kind, limit)
    assert all(packing.tokens(p) <= limit for p in got)
    assert "".join("".join(got).split()) == "".join(text.split())


def test_shortening():
    assert packing.shorten("a /* x\ny */ b // c\n\n\n\nd  ", "java") == "a  b\n\nd"
    assert packing.shorten("<a/><!-- x -->", "xml") == "<a/>"
