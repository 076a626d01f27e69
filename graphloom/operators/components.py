"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .lookups import SHARE, lookup

#: A node of fewer links is no heavy key, whatever its share of them.
LEAST_HEAVY = 10_000


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v): every neighbour v of u (greater than u in a large star, smaller in a small one) is linked to
    the smallest of u and its neighbours."""
    least = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
    total, most = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    those = pairs.where("v > u") if large else pairs
    met = lookup(those, least, ["u"], "inner", count="n", total=total) if most >= max(LEAST_HEAVY, SHARE * total) else those.join(least, "u")
    linked = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return written(linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of each component, for all nodes with a link to another node.

    Large stars link larger neighbours, small stars smaller ones, to the least neighbour, until every node hangs on its
    component's least node; the number of rounds grows with the logarithm of a component's size. A heavy node's links
    are never gathered in one task. Steps are written as tables, whose sizes are known: those estimated for a join of a
    frame with itself would square with every step. Links with a null end and links of a node to itself are ignored.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole"))
    edges = written(ends.where("whole and u <> v").select("u", "v").distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _star(_star(both, True), False)
        was, now = now, mark(edges)
        if now == was:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
