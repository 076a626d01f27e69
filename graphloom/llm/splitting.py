"""Cutting oversized texts into pieces under a token limit at natural boundaries, with line overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import tokens

#: What a section of a kind of file begins with, after a blank line (fixed values).
SECTIONS = {
    "java": r"[ \t]*(?:public|private|protected|static|abstract|final|class|interface|enum|@|/\*\*)",
    "xml": r"[ \t]{0,2}<[A-Za-z!?]",
    "md": r"#{1,6} ",
    "properties": r"[#!]",
}
OTHER_SECTION = r"(?:#|<[A-Za-z!?])"


def tidy(c: Column) -> Column:
    """Blanks and tabs off the end of every line, three or more newlines become two; linear in the text."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<![ \t])[ \t]++(?=\n|\z)", ""), r"\n{3,}+", "\n\n")


def limit_bytes(limit: int) -> int:
    """The most UTF-8 bytes that count as at most ``limit`` tokens by the project's estimate."""
    return (limit * 32 + 31) // 10


def _pattern(most: int, room: Column, kind: Column) -> Column:
    """The cutting pattern for one text: alternatives by boundary strength, each consuming as much as it can.

    ``most``: bytes in a piece; ``room``: bytes left for new text when the overlap is set aside. In order: all that is
    left; up to a section; up to a paragraph; up to a line end; one line that needs the overlap's room; and only in a
    line longer than a piece a cut between characters (bytes 80-BF continue a character).
    """
    section = F.lit(OTHER_SECTION)
    for ext, begins in SECTIONS.items():
        section = F.when(kind == ext, begins).otherwise(section)
    up_to = F.concat(F.lit(".{1,"), room.cast("string"), F.lit("}"))
    return F.concat(
        F.lit("(?s)"), up_to, F.lit(r"+\z|"),
        up_to, F.lit(r"(?<=\n\r?\n)(?="), section, F.lit(")|"),
        up_to, F.lit(r"(?<=\n\r?\n)(?!\n)|"),
        up_to, F.lit(r"(?<=\n)|"),
        F.lit(rf"[^\n]{{1,{most}}}+(?:\n|\z)|"),
        up_to, F.lit(r"(?![\x80-\xBF])|.[\x80-\xBF]*"),
    )


def split(df: DataFrame, key: str, content: str, path: str, limit: int = 1000, overlap: int = 3) -> DataFrame:
    """(key, chunk_index, chunk_total, content, from_byte, to_byte, hard_cut) for texts above ``limit`` tokens.

    Every piece has at most ``limit`` tokens. Piece k > 0 starts with the last ``overlap`` lines of piece k - 1, or as
    many of them as fit; room for them is set aside by the longest such run of lines in the text, half the limit at
    most. ``from_byte`` and ``to_byte`` give the new text in the tidied content, and these ranges follow each other
    without a gap; newlines at a piece's end are not part of its ``content``. ``hard_cut`` is 1 where the pattern's last
    alternative had to cut inside a line: a cut before the last one that ends without a newline. Null, empty and small texts give no rows; repeated rows count once; other columns
    are ignored. Bytes are counted by reading the UTF-8 bytes as Latin-1, so a quantifier is a byte limit.
    """
    most = limit_bytes(limit)
    rows = df.select(F.col(key).alias("__key"), F.col(path).alias("__path"), tidy(F.col(content)).alias("__text")).where(tokens(F.col("__text")) > limit).dropDuplicates(["__key"])
    kind = F.lower(F.regexp_extract(F.coalesce("__path", F.lit("")), r"\.([A-Za-z]+)$", 1))

    def cut(text: Column) -> Column:
        lines = F.transform(F.split("__text", "\n"), lambda x: F.octet_length(x))
        inside = lambda cuts: F.exists(F.slice(cuts, F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(0))), lambda x: ~F.endswith(x, F.lit("\n")))
        return _let(lines, lambda n: _let(F.regexp_extract_all(text, _pattern(most, _room(n, most, overlap), kind), F.lit(0)), lambda cuts: pieces(cuts, inside(cuts))))

    def pieces(cuts: Column, long: Column) -> Column:
        # what stands before each cut, as far back as its overlap can reach
        before = F.transform(cuts, lambda _, i: F.array_join(F.slice(cuts, F.greatest(i - overlap, F.lit(0)) + 1, F.least(i, F.lit(overlap))), ""))
        marked = lambda back: F.aggregate(F.zip_with(back, cuts, lambda w, x: _mark(w, x, overlap)), _start(), lambda s, x: _step(s, x, most), lambda s: s["out"])
        joined = lambda back, leads: F.transform(
            cuts, lambda x, i: F.struct(F.get(leads, i).alias("l"), F.right(F.get(back, i), F.get(leads, i)["lead"]).alias("lead"), x.alias("cut"), F.size(cuts).alias("total"), long.alias("long"))
        )
        return _let(before, lambda back: _let(marked(back), lambda leads: joined(back, leads)))

    out = rows.select("__key", F.posexplode(_let(F.decode(F.encode("__text", "UTF-8"), "ISO-8859-1"), cut)).alias("chunk_index", "p"))
    text = F.decode(F.encode(F.rtrim(F.concat("p.lead", "p.cut"), F.lit("\n")), "ISO-8859-1"), "UTF-8")
    at = F.col("p.l.at")
    return out.select(
        F.col("__key").alias(key), "chunk_index", F.col("p.total").alias("chunk_total"), text.alias(content), at.alias("from_byte"), (at + F.length("p.cut")).alias("to_byte"), F.col("p.long").cast("int").alias("hard_cut")
    )


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of ``value``, evaluated once: an array function's variable holds it, so no optimizer rule copies the expression."""
    return F.transform(F.array(value), body)[0]


def _room(lines: Column, most: int, overlap: int) -> Column:
    """Bytes for new text: a piece less the longest run of ``overlap`` lines, half a piece at least."""
    runs = F.transform(lines, lambda _, i: F.aggregate(F.slice(lines, i + 1, overlap), F.lit(overlap), lambda s, x: s + x))
    return F.lit(most) - F.least(F.array_max(runs), F.lit(most // 2))


def _mark(before: Column, cut: Column, overlap: int) -> Column:
    """Of a cut: its bytes, its bytes without the newlines at its end, and the bytes of the last ``overlap``, ... 1 lines before it."""

    def tails(bare: Column) -> Column:
        gap = F.length(before) - F.length(bare)
        last = _let(F.split(bare, "\n"), lambda x: F.transform(F.slice(x, F.greatest(F.size(x) - overlap + 1, F.lit(1)), overlap), lambda y: F.length(y)))
        sums = _let(last, lambda x: F.transform(F.sequence(F.size(x), F.lit(1), F.lit(-1)), lambda k: F.aggregate(F.slice(x, F.size(x) - k + 1, k), gap + k - 1, lambda s, y: s + y)))
        return F.when(before == "", F.array().cast("array<int>")).otherwise(sums)

    return F.struct(F.length(cut).alias("bytes"), F.length(F.rtrim(cut, F.lit("\n"))).alias("bare"), _let(F.rtrim(before, F.lit("\n")), tails).alias("tails"))


def _start() -> Column:
    return F.struct(F.array().cast("array<struct<lead:int,at:int>>").alias("out"), F.lit(0).alias("had"), F.lit(0).alias("at"))


def _step(s: Column, x: Column, most: int) -> Column:
    """Choose a cut's overlap: the most lines that fit and lie within the piece before, of which ``had`` bytes there are."""
    lead = F.coalesce(F.get(F.filter(x["tails"], lambda t: (t + x["bare"] <= most) & (t <= s["had"])), F.lit(0)), F.lit(0))
    return _let(lead, lambda n: F.struct(F.array_append(s["out"], F.struct(n.alias("lead"), s["at"].alias("at"))).alias("out"), (n + x["bytes"]).alias("had"), (s["at"] + x["bytes"]).alias("at")))
