"""Names that contain each other, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str, least: int = 4) -> DataFrame:
    """(left_key, right_key): pairs of which one's ``text`` stands in the other's, both of at least ``least`` characters.

    A text that stands in another begins somewhere in it: the first ``least`` characters of the one are looked up among
    all stretches of that length of the other, an equi-join in each direction, and the containment is then checked. Null
    and shorter texts pair with nothing; repeated rows count once.
    """
    sides = [df.where(F.length(text) >= least).select(F.col(key).alias(name), F.col(text).alias(f"{name}_t")).distinct() for df, key, name in ((left, left_key, "l"), (right, right_key, "r"))]
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(F.col(c), i, F.lit(least)))))

    def inside(small: DataFrame, s: str, large: DataFrame, x: str) -> DataFrame:
        met = small.withColumn("g", F.substring(f"{s}_t", 1, least)).join(large.withColumn("g", grams(f"{x}_t")), "g")
        return met.where(F.contains(f"{x}_t", F.col(f"{s}_t"))).select("l", "r")

    return inside(sides[0], "l", sides[1], "r").unionByName(inside(sides[1], "r", sides[0], "l")).distinct().toDF(left_key, right_key)
