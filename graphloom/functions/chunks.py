"""Program source in pieces under a budget: data units, a ladder of boundaries, notes cut to what a reader needs.

Sequential folds are Python functions over one text; ``piece_rows`` runs them over a column in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import tokens

#: Where a unit of the data division begins, where a statement ends, and words that begin a block of control (fixed values).
UNIT = re.compile(r"\s+(?:[A-Z][A-Z0-9_-]+\s+SECTION\.\s*$|(?:FD|01)\s+[A-Z0-9_-]+)", re.I)
CONTROL = re.compile(r"\s+(?:EVALUATE|IF|PERFORM|CALL|READ|WRITE|EXEC|GO\s+TO)\b", re.I)
#: What a line of findings holds (fixed values).
FINDINGS = r"^(?:[-*#]|[1-9].?\.)|PROGRAM-ID|COPY |CALL |PERFORM |[→←]"


def data_units(text: str | None) -> list[str]:
    """A data division as sections, file descriptions and records, each from its first line to the next unit's; blank ones are left out."""
    out: list[list[str]] = [[]]
    for line in (text or "").split("\n"):
        if UNIT.match(line) and out[-1]:
            out.append([])
        out[-1].append(line)
    return [u for u in ("\n".join(x) for x in out) if u.strip()]


def at_boundaries(lines: list[str], budget: int, ends: Callable[[str], bool]) -> list[list[str]]:
    """Lines filled up greedily: a piece is closed where the next line would break the budget and the last one is a boundary.

    Tokens are counted line by line and rounded down each, so a piece may have a little more.
    """
    out: list[list[str]] = [[]]
    size = 0
    for line in lines:
        more = tokens(line + "\n")
        if out[-1] and size + more > budget and ends(out[-1][-1]):
            out.append([])
            size = 0
        out[-1].append(line)
        size += more
    return [x for x in out if x]


def oversized(name: str, text: str, budget: int) -> list[tuple[str, str]]:
    """(name.partN, text): a paragraph over the budget cut at statement ends; where these don't part it, after control
    words; where these don't either, at any line. One within the budget keeps its name."""
    if tokens(text) <= budget:
        return [(name, text)]
    rungs = (lambda x: x.rstrip().endswith("."), lambda x: bool(CONTROL.match(x)), lambda _: True)
    tries = (at_boundaries(text.split("\n"), budget, ends) for ends in rungs)
    parts = next((x for x in tries if len(x) > 1), [text.split("\n")])
    return [(f"{name}.part{n}", "\n".join(x)) for n, x in enumerate(parts, 1)]


def chunked(data: str | None, procedures: list[tuple[str, str]], preamble: str, budget: int) -> list[str]:
    """A program in chunks: data units, then paragraphs, filled up in order after the preamble on the first chunk; a
    program within the budget is one chunk. An oversized unit is cut by ``oversized``."""
    units = [("", u) for u in data_units(data)] + list(procedures)
    whole = "\n".join(x for x in [preamble, *(t for _, t in units)] if x)
    if tokens(whole) <= budget:
        return [whole] if whole.strip() else []
    out, now = [], preamble
    for name, text in units:
        for _, piece in oversized(name, text, budget):
            joined = f"{now}\n{piece}" if now else piece
            if now and tokens(joined) > budget:
                out.append(now)
                joined = piece
            now = joined
    return [*out, now] if now else out


def piece_rows(cut: Callable[[str], list[str]]):
    """A column function of text: the pieces that ``cut`` makes of it; null gives none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([cut(t) if t else [] for t in texts])

    return run


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` bytes and three dots, where there are more; a character that the cut would halve is left out."""
    raw = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    head = F.regexp_replace(F.substring(raw, 1, most), r"(?:[\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF4][\x80-\xBF]{0,2})\z", "")
    return F.when(F.octet_length(text) > most, F.concat(F.decode(F.encode(head, "ISO-8859-1"), "UTF-8"), F.lit("..."))).otherwise(text)


def outline(text: Column, most: int) -> Column:
    """Of a text over ``most`` bytes its bullets, headings, numbered lines and lines that name parts of programs, truncated; the truncated text where there are none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.array_join(F.filter(lines, lambda x: x.rlike(FINDINGS)), "\n")
    return F.when(F.octet_length(text) <= most, text).when(kept == "", truncated(text, most)).otherwise(truncated(kept, most))


def marked_sections(text: Column, markers: list[str], least: int = 3) -> Column:
    """Array of (marker, content): what stands between a marker and the next later one of the list; null where fewer than ``least`` markers stand in the text."""
    literal = [re.sub(r"([^A-Za-z0-9\s])", r"\\\1", m) for m in markers]
    found = [F.contains(text, F.lit(m)) for m in markers]
    content = [F.regexp_extract(text, f"(?s){m}(.*?)(?:{'|'.join([*literal[i + 1 :], chr(92) + 'z'])})", 1) for i, m in enumerate(literal)]
    parts = F.array(*[F.when(f, F.struct(F.lit(m).alias("marker"), c.alias("content"))) for m, f, c in zip(markers, found, content)])
    return F.when(sum((f.cast("int") for f in found), F.lit(0)) >= least, F.filter(parts, lambda p: p.isNotNull()))


def for_repair(text: Column, budget: int, data: Column, procedure: Column) -> Column:
    """The whole text within the budget, else its data and procedure divisions, else the procedure division, else a cut after four characters a token."""
    size = lambda c: F.floor(F.octet_length(c) * 10 / 32)
    both = F.concat_ws("\n", data, procedure)
    return F.when(size(text) <= budget, text).when((both != "") & (size(both) <= budget), both).when(size(procedure) <= budget, procedure).otherwise(F.substring(F.coalesce(procedure, text), 1, budget * 4))
