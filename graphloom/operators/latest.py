"""The row that holds now, of several versions of a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """(key, columns...) of the row with the latest ``at`` per key; ties go to the largest values, a null ``at`` loses.

    One map-side combined aggregation; whole-row repeats vanish in it. Rows with a null key drop out.
    """
    best = F.max(F.struct(F.col(at).alias("__at"), *[F.col(c) for c in columns])).alias("__best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"__best.{c}").alias(c) for c in columns])
