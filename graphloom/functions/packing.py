"""Chunks under a token limit by greedy packing of sections: a sequential fold, so Arrow-batched Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where a section may begin, by kind of file (fixed values).
BEGINS = {
    "java": re.compile(r"^\s*(?:public|private|protected|static|class|interface|enum|@\w+)\b"),
    "md": re.compile(r"^#{1,6}\s"),
    "cbl": re.compile(r"^(?:\d{6}[ \t]{1,4}|[ \t]{1,10})[A-Za-z0-9][A-Za-z0-9_-]*(?:\s+SECTION)?\.\s*$"),
}
_COMMENT = {"java": re.compile(r"/\*.*?\*/|//[^\n]*", re.S), "xml": re.compile(r"<!--.*?-->", re.S)}


def tokens(s: str) -> int:
    return len(s.encode()) * 10 // 32


def shorten(text: str, kind: str) -> str:
    """Comments of the kind, blanks at line ends and surplus blank lines removed."""
    if kind in _COMMENT:
        text = _COMMENT[kind].sub("", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|$)", "", text))


def sections(text: str, kind: str) -> list[str]:
    """Sections by the kind's boundaries, else by blank lines; blank ones are left out."""
    begins = BEGINS.get(kind)
    if begins is None:
        parts = re.split(r"\n\n+", text)
    else:
        parts, now = [], []
        for line in text.split("\n"):
            if begins.match(line) and now:
                parts.append("\n".join(now))
                now = []
            now.append(line)
        parts.append("\n".join(now))
    return [p for p in parts if p.strip()]


def _fill(units: list[str], limit: int, glue: str) -> list[str]:
    out: list[str] = []
    for u in units:
        if out and tokens(out[-1] + glue + u) <= limit:
            out[-1] += glue + u
        else:
            out.append(u)
    return out


def _halves(line: str, limit: int) -> list[str]:
    step = max(1, limit * 32 // 40)
    return [line[i : i + step] for i in range(0, len(line), step)] if tokens(line) > limit else [line]


def pack(text: str | None, kind: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` tokens: sections filled up in order; a section over the limit by lines, a line over it by characters."""
    if not text or not text.strip():
        return []
    if tokens(text) <= limit:
        return [text]
    units: list[str] = []
    for s in sections(text, kind):
        units += [s] if tokens(s) <= limit else _fill([h for line in s.split("\n") for h in _halves(line, limit)], limit, "\n")
    return _fill(units, limit, "\n")


def packed(limit: int):
    """A column function of (text, kind): the packed pieces."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, kind in parts:
            yield pd.Series([pack(t, k or "", limit) for t, k in zip(text, kind)])

    return run
