"""Heavy keys: find them exactly and cheaply, and split them by a deterministic salt.

At most ``1 / share`` keys can each hold ``share`` of all rows, so the list of heavy keys has a bound that doesn't
depend on the data. Counting is a map-side combined aggregation; the hot key never reaches one task as rows.
The salt is a hash of a member column and not ``rand()``: a task that is run again gives the same rows, and equal
members meet under the same salt, which keeps distinct counts exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, keys: list[str], share: float = 1 / 256, total: int | None = None) -> list[tuple]:
    """Keys holding at least ``share`` of the rows, with their counts; at most ``1 / share`` rows come to the driver.

    ``total`` is the number of rows where the caller knows it; else it is summed from the same counts by a subquery
    that shares their shuffle. Null keys count as a key. An empty frame has no heavy keys.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows = F.lit(total) if total is not None else counts.agg(F.sum("__n")).scalar()
    return [tuple(r) for r in counts.where((F.col("__n") >= 2) & (F.col("__n") >= F.lit(share) * rows)).collect()]


def split_table(spark: SparkSession, df: DataFrame, keys: list[str], heavy: list[tuple], splits: int) -> DataFrame:
    """(keys..., __splits) of the heavy keys, as a frame to broadcast: its size is bounded by ``heavy_keys``."""
    rows = [F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, h)], F.lit(splits).alias("__splits")) for h in heavy]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*rows))))


def salted(df: DataFrame, keys: list[str], heavy: list[tuple], splits: int, member: Column) -> DataFrame:
    """Adds ``__salt``: 0 for light keys, ``hash(member) mod splits`` for heavy ones."""
    if not heavy:
        return df.withColumn("__salt", F.lit(0))
    table = split_table(df.sparkSession, df, keys, heavy, splits)
    cond = [df[k].eqNullSafe(table[k]) for k in keys]
    joined = df.join(table, cond, "left").select(df["*"], table["__splits"])
    return joined.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(member), F.col("__splits")).cast("int"), F.lit(0))).drop("__splits")


def replicated(df: DataFrame, keys: list[str], heavy: list[tuple], splits: int) -> DataFrame:
    """The other side of a salted join: a row of a heavy key once per salt, any other row once."""
    if not heavy:
        return df.withColumn("__salt", F.lit(0))
    table = split_table(df.sparkSession, df, keys, heavy, splits)
    cond = [df[k].eqNullSafe(table[k]) for k in keys]
    joined = df.join(table, cond, "left").select(df["*"], table["__splits"])
    return joined.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__splits"), F.lit(1)) - 1))).drop("__splits")


def count_distinct_per_key(df: DataFrame, key: str, member: str, splits: int | None = None, share: float = 1 / 256) -> DataFrame:
    """(key, n): distinct ``member`` values per ``key`` by two-stage salted aggregation.

    Heavy keys get a salt from their members; stage one counts distinct members per (key, salt) after one shuffle on
    both, stage two adds the partial counts by key. Rows with a null key or member don't count; repeated rows count
    once; an empty frame gives no rows. Other columns of ``df``, whatever their names, are ignored.
    """
    pairs = df.select(F.col(key).alias("__k"), F.col(member).alias("__m")).where("__k is not null and __m is not null")
    splits = splits or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = heavy_keys(pairs, ["__k"], share)
    once = salted(pairs, ["__k"], heavy, splits, F.col("__m")).groupBy("__k", "__salt", "__m").agg(F.lit(1).alias("__one"))
    partial = once.groupBy("__k", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    return partial.groupBy(F.col("__k").alias(key)).agg(F.sum("__n").alias("n"))
