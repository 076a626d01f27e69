"""Upserts as pure functions: last writer wins column by column, lists grow, edges need both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(rows: DataFrame, key: str, seq: str, columns: list[str], shared: list[str] = ()) -> DataFrame:
    """One row per key: of each column the value of the latest row that has one; ``shared`` columns collect all values.

    ``rows`` holds what was there and what comes in, ordered by ``seq`` (ties go to the larger value). A null leaves a
    property as it is. Rows with a null key drop out.
    """
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(c).alias("v")))).alias(f"__{c}") for c in columns]
    every = [F.array_sort(F.collect_set(c)).alias(c) for c in shared]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*last, *every).select(key, *[F.col(f"__{c}.v").alias(c) for c in columns], *shared)


def upsert_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame, seq: str, columns: list[str]) -> DataFrame:
    """At most one edge per (type, src, dst), later properties over earlier ones; edges without both ends drop out.

    ``sources`` and ``targets`` have a column ``node``.
    """
    known = edges.join(sources.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(targets.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(c).alias("v")))).alias(f"__{c}") for c in columns]
    return known.groupBy("type", "src", "dst").agg(*last, F.count(F.lit(1)).alias("__n")).select("type", "src", "dst", *[F.col(f"__{c}.v").alias(c) for c in columns])


def stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): edge targets without a node, once each."""
    return edges.select(F.col("dst").alias("node")).where("node is not null").distinct().join(nodes.select("node"), "node", "left_anti")
