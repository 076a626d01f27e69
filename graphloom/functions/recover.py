"""Recovery of JSON from model answers: fences, prose around it, comments, trailing commas, truncation."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"^\s*```[^\n]*\n|\n?```\s*$")
#: A string, a comment, or a comma that closes nothing: alternatives are tried in this order, so strings are never touched.
_PIECE = re.compile(r'("(?:[^"\\]|\\.)*(?:"|\Z))|//[^\n]*|/\*.*?(?:\*/|\Z)|,(?=\s*[}\]])', re.S)
_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+)', re.S)


def clean(raw: str) -> str:
    """Fences, prose before the first bracket and after the last one, comments and trailing commas removed."""
    s = _FENCE.sub("", raw)
    starts = [i for i in (s.find("{"), s.find("[")) if i >= 0]
    if starts:
        s = s[min(starts) :]
    end = max(s.rfind("}"), s.rfind("]"))
    if 0 <= end < len(s) - 1 and not re.search(r'[{}\[\],:"]', s[end + 1 :]):
        s = s[: end + 1]
    return _PIECE.sub(lambda m: m[1] or "", s)


def recover(raw: str | None) -> str | None:
    """Valid JSON, as much of ``raw`` as can be kept; null if nothing can.

    A truncated text is cut back to the end of an element, the latest that gives valid JSON, and closed: one pass over
    the tokens follows the open brackets and what may come next, up to an unclosed string or whatever can't be JSON.
    """
    if not raw:
        return None
    s = clean(raw)
    try:
        json.loads(s)
        return s
    except ValueError:
        pass
    open_, state, end, at = [], "value", None, 0
    while state != "done" and (m := _TOKEN.match(s, at)):
        t, at = m[1], m.end()
        if t in "}]":
            # after an opening bracket or a value; a comma or colon before leaves an element unfinished
            if state not in ("first key", "first", "next") or open_[-1] != t:
                break
            open_.pop()
        elif state == "next":
            if t != ",":
                break
            state = "key" if open_[-1] == "}" else "value"
            continue
        elif state == "colon":
            if t != ":":
                break
            state = "value"
            continue
        elif state in ("first key", "key"):
            if t[0] != '"' or not _valid(t):
                break
            state = "colon"
            continue
        elif t in "{[":
            open_.append("}" if t == "{" else "]")
            state, end = "first key" if t == "{" else "first", at
            continue
        elif not _valid(t):
            break
        # a value is complete
        state, end = "next" if open_ else "done", at
    return None if end is None else s[:end] + "".join(reversed(open_))


def _valid(token: str) -> bool:
    try:
        json.loads(token)
        return True
    except ValueError:
        return False


@F.pandas_udf(T.StringType())
def recovered(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``recover`` over a column."""
    for part in texts:
        yield part.map(recover)
