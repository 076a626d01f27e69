"""Column expressions on program source and names: columns, continuation lines, divisions, PIC clauses, fuzzy names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name endings that an abbreviation drops, one after the other (fixed values).
SUFFIXES = ("SERVICE", "CONTROLLER", "ADAPTER", "GATEWAY", "HANDLER", "MANAGER")
#: Division headers (fixed values).
DIVISIONS = ("IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE")


def _let(value: Column, body) -> Column:  # noqa: ANN001
    return F.transform(F.array(value), body)[0]


def strip_sequence(text: Column) -> Column:
    """Bytes 7 to 72 of every line; lines under seven bytes stay. A character that an edge cuts in two drops out.

    The UTF-8 bytes are read as Latin-1, so a character is a byte.
    """
    lines = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "\n")
    whole = lambda x: F.regexp_replace(x, r"^[\x80-\xBF]+|(?:[\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF4][\x80-\xBF]{0,2})\z", "")
    cut = F.array_join(F.transform(lines, lambda x: F.when(F.length(x) < 7, x).otherwise(whole(F.substring(x, 7, 66)))), "\n")
    return F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8")


def join_continuations(text: Column) -> Column:
    """Lines with ``-`` in column 7 go on from the line before, whose blanks at the end are dropped."""
    lines = F.split(text, "\n")
    glue = lambda s, x: F.when(
        (F.substring(x, 7, 1) == "-") & s["any"], F.struct(F.concat(F.rtrim(s["text"]), F.ltrim(F.substring(x, 8, 1_000_000))).alias("text"), F.lit(True).alias("any"))
    ).otherwise(F.struct(F.when(s["any"], F.concat(s["text"], F.lit("\n"), x)).otherwise(x).alias("text"), F.lit(True).alias("any")))
    return F.aggregate(lines, F.struct(F.lit("").alias("text"), F.lit(False).alias("any")), glue, lambda s: s["text"])


def division(text: Column, name: str) -> Column:
    """The text of one division; of several with one header the last, null if there is none. A text without any header is all PROCEDURE."""
    begins = r"^[ \t0-9]{0,11}(" + "|".join(DIVISIONS) + r")[ \t]+DIVISION\b"
    header = "(?im)" + begins + r"[^\n]*"
    parts = F.regexp_extract_all(text, F.lit(header + r"(?s:.*?)(?=\Z|" + begins + ")"), F.lit(0))
    mine = F.filter(parts, lambda p: F.upper(F.regexp_extract(p, header, 1)) == name)
    whole = F.when(F.size(parts) == 0, text) if name == "PROCEDURE" else F.lit(None).cast("string")
    return F.coalesce(F.try_element_at(mine, F.lit(-1)), whole)


def paragraphs(text: Column) -> Column:
    """Array of (name, body): a paragraph begins at a line with a name and a full stop only, or at a section,
    in columns 8 to 11; names further in are statements; text before the first is PREAMBLE."""
    begins = r"^(?:[0-9]{6}[ \t]{1,4}|[ \t]{1,10})([A-Z0-9][A-Z0-9_-]*)(?:[ \t]+SECTION)?\.[ \t]*$"
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def step(s: Column, x: Column) -> Column:
        name = F.upper(F.regexp_extract(x, "(?i)" + begins, 1))
        return F.when(name != "", F.struct(F.array_append(s["done"], F.struct(s["name"].alias("name"), s["body"].alias("body"))).alias("done"), name.alias("name"), F.lit("").alias("body"))).otherwise(
            F.struct(s["done"].alias("done"), s["name"].alias("name"), F.concat(s["body"], x, F.lit("\n")).alias("body"))
        )

    zero = F.struct(F.array().cast("array<struct<name:string,body:string>>").alias("done"), F.lit("PREAMBLE").alias("name"), F.lit("").alias("body"))
    every = F.aggregate(lines, zero, step, lambda s: F.array_append(s["done"], F.struct(s["name"].alias("name"), s["body"].alias("body"))))
    return F.filter(every, lambda p: (p["name"] != "PREAMBLE") | p["body"].rlike(r"\S"))


def _digits(clause: Column, symbol: str) -> Column:
    """How often a symbol stands in a clause, repeats in brackets counted."""
    return F.aggregate(
        F.regexp_extract_all(clause, F.lit(rf"{symbol}(?:\((\d{{1,6}})\))?"), F.lit(1)), F.lit(0), lambda s, x: s + F.when(x == "", 1).otherwise(x.cast("int"))
    )


def pic_types(picture: Column, usage: Column) -> Column:
    """struct(java, sql, storage, bytes) of a PIC clause and USAGE; an empty or null clause gives null."""
    bare = F.regexp_replace(F.upper(F.trim(picture)), r"^PIC\s*", "")
    use = F.upper(F.trim(F.coalesce(usage, F.lit(""))))

    def of(p: Column) -> Column:
        signed, body = p.startswith("S").cast("int"), F.regexp_replace(p, "^S", "")
        whole, fraction = _digits(F.substring_index(body, "V", 1), "9"), F.when(F.contains(body, F.lit("V")), _digits(F.regexp_extract(body, r"V(.*)$", 1), "9")).otherwise(0)
        digits = whole + fraction
        kind = lambda java, sql, storage, size: F.struct(java.alias("java"), sql.alias("sql"), F.lit(storage).alias("storage"), size.cast("int").alias("bytes"))
        decimal = F.concat(F.lit("DECIMAL("), digits, F.lit(","), fraction, F.lit(")"))
        chars = lambda n: kind(F.lit("String"), F.concat(F.lit("VARCHAR("), n, F.lit(")")), "DISPLAY", n)
        size = F.when(digits <= 4, 2).when(digits <= 9, 4).otherwise(8)
        whole_sql, whole_java = F.when(digits <= 9, "INTEGER").otherwise("BIGINT"), F.when(digits <= 9, "int").otherwise("long")
        return (
            F.when(F.contains(body, F.lit("X")), chars(_digits(body, "X")))
            .when(F.contains(body, F.lit("A")) & ~F.contains(F.regexp_replace(body, r"\(\d+\)", ""), F.lit("9")), chars(_digits(body, "A")))
            .when(use.isin("COMP-3", "PACKED-DECIMAL"), kind(F.lit("BigDecimal"), decimal, "PACKED_DECIMAL", F.floor((digits + signed + 1) / 2)))
            .when(use.isin("COMP", "BINARY", "COMP-4"), kind(F.when(size == 2, "short").when(size == 4, "int").otherwise("long"), F.when(size == 2, "SMALLINT").when(size == 4, "INTEGER").otherwise("BIGINT"), "BINARY", size))
            .when(fraction > 0, kind(F.lit("BigDecimal"), decimal, "DISPLAY", digits + signed))
            .otherwise(kind(whole_java, whole_sql, "DISPLAY", digits + signed))
        )

    return F.when(F.coalesce(picture, F.lit("")) != "", _let(bare, of))


def abbreviate(name: Column) -> Column:
    """Endings dropped in order, vowels after the first letter dropped, eight letters at most."""
    for s in SUFFIXES:
        name = F.regexp_replace(name, s + "$", "")
    return F.substring(F.concat(F.substring(name, 1, 1), F.regexp_replace(F.substring(name, 2, 1_000), "[AEIOU]", "")), 1, 8)


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that two names begin with alike."""
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: F.left(a, n) == F.left(b, n))), F.lit(0))


def fuzzy(a: Column, b: Column) -> Column:
    """struct(score, reason) of two names by the first rung that holds: equal, contained, prefix, abbreviation, edit distance; null below all."""
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    rung = lambda score, reason: F.struct(score.cast("double").alias("score"), F.lit(reason).alias("reason"))
    short = F.least(F.length(x), F.length(y))
    prefix = shared_prefix(x, y)
    near = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    held = ((F.length(y) >= 4) & F.contains(x, y)) | ((F.length(x) >= 4) & F.contains(y, x))
    return (
        F.when((x == "") | (y == ""), None)
        .when(x == y, rung(F.lit(1.0), "exact_match"))
        .when(held, rung(F.lit(0.8), "substring_contains"))
        .when((prefix >= 4) & (prefix / short >= 0.5), rung(prefix / short, "shared_prefix"))
        .when((F.length(abbreviate(x)) >= 4) & (abbreviate(x) == abbreviate(y)), rung(F.lit(0.7), "cobol_abbreviation"))
        .when(near >= 0.6, rung(near, "levenshtein"))
    )


def cap_list(items: Column, most: int) -> Column:
    """As many items as fit ``most`` tokens, joined by commas, and how many more there are."""
    fits = F.aggregate(items, F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: _cap(s, x, most), lambda s: F.struct(s["t"].alias("t"), s["n"].alias("n")))
    left = F.size(items) - fits["n"]
    return F.when(left > 0, F.concat(fits["t"], F.when(fits["n"] > 0, ", ").otherwise(""), F.lit("… and "), left, F.lit(" more"))).otherwise(fits["t"])


def _cap(s: Column, x: Column, most: int) -> Column:
    longer = F.concat(s["t"], F.when(s["n"] > 0, ", ").otherwise(""), x)
    fits = s["on"] & (F.floor(F.octet_length(longer) * 10 / 32) <= most)
    return F.when(fits, F.struct(longer.alias("t"), (s["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(s["t"].alias("t"), s["n"].alias("n"), F.lit(False).alias("on")))


def snippet(text: Column, most: int) -> Column:
    """A text of at most ``most`` lines whole; else its head, a stretch from the middle and its tail, with marks between."""
    head, mid = max(10, most * 53 // 100), max(5, most * 20 // 100)
    tail = max(5, most - head - mid)
    lines = F.split(text, "\n")
    at = F.floor((F.size(lines) - mid) / 2).cast("int")
    cut = F.concat(F.slice(lines, 1, head), F.array(F.lit("...")), F.slice(lines, at + 1, mid), F.array(F.lit("...")), F.slice(lines, F.size(lines) - tail + 1, tail))
    return F.when(F.size(lines) <= most, text).otherwise(F.array_join(cut, "\n"))


def blocks(text: Column, language: str) -> Column:
    """The bodies of fenced code blocks of one language."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)```{language}[ \t]*\n(.*?)```"), F.lit(1))


def preamble(text: Column) -> Column:
    """What a later chunk needs to know of the divisions before: program, files, sections, top-level items, copy members."""
    named = lambda label, part, pattern: F.when(
        F.size(F.regexp_extract_all(part, F.lit(pattern), F.lit(1))) > 0, F.concat(F.lit(label), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(part, F.lit(pattern), F.lit(1)))), ", "))
    )
    data, env, ident = (F.coalesce(division(text, d), F.lit("")) for d in ("DATA", "ENVIRONMENT", "IDENTIFICATION"))
    return F.concat_ws(
        "\n",
        named("PROGRAM-ID ", ident, r"(?i)PROGRAM-ID\.\s*([A-Za-z0-9_-]+)"),
        named("SELECT ", env, r"(?im)\bSELECT\s+([A-Za-z0-9_-]+)"),
        named("SECTION ", data, r"(?im)^[ \t0-9]*([A-Za-z-]+)[ \t]+SECTION\."),
        named("01 ", data, r"(?im)^[ \t0-9]*\b01[ \t]+([A-Za-z0-9_-]+)"),
        named("COPY ", text, r"(?im)^[ \t0-9]*COPY[ \t]+([A-Za-z0-9_-]+)"),
    )


def java_outline(text: Column) -> Column:
    """Package, imported packages, types and method signatures of a Java text."""
    every = lambda pattern, group=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    packages = F.array_sort(F.array_distinct(every(r"(?m)^import\s+(?:static\s+)?([\w.]+)\.[\w*]+;")))
    return F.concat_ws(
        "\n",
        F.when(F.size(every(r"(?m)^package\s+([\w.]+);")) > 0, F.concat(F.lit("package "), F.get(every(r"(?m)^package\s+([\w.]+);"), F.lit(0)))),
        F.when(F.size(packages) > 0, F.concat(F.lit("imports "), F.array_join(packages, ", "))),
        F.array_join(F.transform(every(r"(?m)^\s*((?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum)\s+\w+|(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\], ]+\s+\w+\([^)]*\))"), lambda x: F.trim(x)), "\n"),
    )
