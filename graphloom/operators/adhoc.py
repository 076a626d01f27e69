"""Ad-hoc read-only SQL: a guard by parsing, row limits with a truncation flag, a time limit."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

DEFAULT_ROWS, MOST_ROWS, SECONDS = 100, 1000, 30
#: Words by which the textual guard tells a writing statement (fixed values).
WRITING = ("CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "CALL", "LOAD", "FOREACH", "INSERT", "UPDATE", "ALTER")
_QUOTED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`[^`]*(?:`|\Z)", re.S)


@dataclass
class Answer:
    columns: list[str]
    rows: list[tuple]
    elapsed_ms: int
    truncated: bool


def bare(text: str) -> str:
    """A statement without quoted text, quoted names and comments."""
    return _QUOTED.sub(" ", text)


def writes(text: str) -> bool:
    """The textual guard: whether a writing word stands in the statement as a word of its own."""
    return re.search(r"\b(" + "|".join(WRITING) + r")\b", bare(text).upper()) is not None


def reads_only(spark: SparkSession, text: str) -> bool:
    """Whether the parsed statement is a query: no command anywhere in its plan."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    it = plan.collectLeaves().iterator()
    kinds = [plan.getClass().getName()]
    while it.hasNext():
        kinds.append(it.next().getClass().getName())
    return not any(".command." in k or "Command" in k or re.search(r"\.(Insert|Create|Drop|Delete|Update|Merge|Alter|Truncate|Replace|Set|Analyze|Cache|Refresh)\w*$", k) for k in kinds)


def clamp(limit: int | None) -> int:
    return DEFAULT_ROWS if not limit or limit <= 0 else min(limit, MOST_ROWS)


def ask(spark: SparkSession, text: str, limit: int | None = None, args: dict | None = None, seconds: float = SECONDS) -> Answer:
    """Run a query over the session's views; one row more than the limit is asked for, which tells whether there are more."""
    if not reads_only(spark, text):
        raise PermissionError("only queries are permitted")
    n, began, group = clamp(limit), time.time(), f"ask-{uuid.uuid4()}"
    df = spark.sql(text, args=args or {})
    sc = spark.sparkContext
    sc.setJobGroup(group, "ad-hoc query", interruptOnCancel=True)
    timer = threading.Timer(seconds, sc.cancelJobGroup, [group])
    timer.start()
    try:
        rows = [tuple(r) for r in df.limit(n + 1).collect()]
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    return Answer(df.columns, rows[:n], int((time.time() - began) * 1000), len(rows) > n)


def page(number: int | None, size: int | None) -> tuple[int, int]:
    """(offset, rows) of a page: pages from 1, sizes from 1 to 100, else 20."""
    number, size = max(1, number or 1), size if size and 1 <= size <= 100 else 20
    return (number - 1) * size, size
