"""Join rows with a table that has one row per key, when one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the rows counts as heavy; there can be 1 / share of them.
SHARE = 1 / 256


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left", count: str | None = None, total: int | None = None) -> DataFrame:
    """``df`` joined with ``table`` (one row per key) without gathering a heavy key in one task.

    Heavy keys number 1 / SHARE at most, so their rows of ``table`` are broadcast; all other keys meet in a shuffle.
    ``count`` names a column of ``table`` that already holds the number of rows per key, ``total`` their sum; else both
    are counted. ``how`` is left or inner; null keys find nothing.
    """
    total = df.count() if total is None else total
    if count is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        heavy_keys = counts.where(F.col("__n") >= F.lit(max(2.0, SHARE * total))).select(*keys).limit(int(1 / SHARE))
        heavy_rows = table.join(F.broadcast(heavy_keys), keys, "left_semi")
    else:
        heavy_rows = table.where(F.col(count) >= F.lit(max(2.0, SHARE * total))).limit(int(1 / SHARE))
    heavy_rows = heavy_rows.withColumn("__heavy", F.lit(True))
    hot = F.broadcast(heavy_rows)
    found = [c for c in table.columns if c not in keys]
    mark = F.broadcast(heavy_rows.select(*keys, "__heavy"))
    easy = df.join(mark, keys, "left").where("__heavy is null").drop("__heavy").join(table, keys, how)
    return df.join(hot, keys, "inner").select(*df.columns, *found).unionByName(easy.select(*df.columns, *found))
