"""Reports as files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    """One header per part file; doubles with one decimal."""
    shown = [F.when(F.col(c).isNotNull(), F.format_string("%.1f", F.col(c))).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def markdown(parts: Iterable[tuple[str, DataFrame]], path: str, rows: int = 1000) -> None:
    """A document with a table per part; a report for readers, so at most ``rows`` rows of each, with a note where there are more."""
    with open(path, "w", encoding="utf-8") as f:
        for title, df in parts:
            f.write(f"## {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n")
            found = df.limit(rows + 1).collect()
            for r in found[:rows]:
                f.write("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |\n")
            f.write("\nMore rows were left out.\n\n" if len(found) > rows else "\n")
