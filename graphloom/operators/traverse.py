"""Bounded traversals as joins: a frontier per hop, what was seen cut away, lineage cut at every hop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, written


def reach(edges: DataFrame, seeds: DataFrame, hops: int, restart: bool = False, limit_rounds: int | None = None, paths: bool = True) -> DataFrame:
    """(key, node, depth, path): nodes met from the seeds within ``hops``, with the least number of hops and the smallest
    shortest path.

    ``edges``: src, dst; an optional column ``key`` keeps edges to the traversal of that key. ``seeds``: key, node. Each
    hop joins the frontier with the edges and drops what was seen under the same key, so cycles end by themselves.
    ``restart`` lets a seed be met again (then with its first return), else seeds stand at depth 0. Null ends never
    match; no seeds give no rows. Without ``paths`` the column path is left out, which spares most of what is shuffled.
    """
    scoped = "key" in edges.columns
    e = edges.where("src is not null and dst is not null").select(*(["key"] if scoped else []), "src", "dst").distinct()
    path = ["path"] if paths else []
    frontier = durable(seeds.select("key", "node").distinct().withColumn("depth", F.lit(0)).withColumn("path", F.array("node")).select("key", "node", "depth", *path))
    seen = None if restart else frontier
    for hop in range(1, hops + 1):
        on = [frontier["node"] == e["src"]] + ([frontier["key"] == e["key"]] if scoped else [])
        step = frontier.join(e, on).select(frontier["key"], e["dst"].alias("node"), *[frontier[c] for c in path])
        step = step.groupBy("key", "node").agg(F.min("path").alias("path")) if paths else step.distinct()
        if seen is not None:
            step = step.join(seen.select("key", "node"), ["key", "node"], "left_anti")
        frontier = durable(step.select("key", "node", F.lit(hop).alias("depth"), *[F.concat(c, F.array("node")).alias(c) for c in path]))
        if frontier.isEmpty():
            break
        seen = frontier if seen is None else seen.unionByName(frontier)
    return frontier if seen is None else seen


def dead_nodes(nodes: DataFrame, edges: DataFrame, hops: int = 50) -> DataFrame:
    """(key, node) that no entry of their key reaches. An entry has no incoming edge; keys without any entry have no dead node.

    ``nodes``: key, node. ``edges``: key, src, dst. All joins are told to merge: the planner takes an exploded list for one
    row, and would have the driver broadcast frames of millions of nodes. Edges are laid out by source once, and each hop
    shuffles only what it met; entries can't be met again.
    """
    pairs = edges.where("key is not null and dst is not null").select("key", "src", "dst")
    flagged = nodes.select("key", "node", F.lit(True).alias("own"), F.lit(False).alias("called"))
    flagged = flagged.unionByName(pairs.select("key", F.col("dst").alias("node"), F.lit(False).alias("own"), F.lit(True).alias("called")))
    marked = written(flagged.groupBy("key", "node").agg(F.bool_or("own").alias("own"), F.bool_or("called").alias("called")).where("own").select("key", "node", "called"))
    entries = marked.where("not called").select("key", "node")
    e = durable(pairs.where("src is not null").repartition("key", "src").distinct().sortWithinPartitions("key", "src"), laid=True)
    frontier, seen = entries, None
    for _ in range(hops):
        step = frontier.withColumnRenamed("node", "src").join(e.hint("merge"), ["key", "src"]).select("key", F.col("dst").alias("node")).distinct()
        frontier = written(step if seen is None else step.join(seen.hint("merge"), ["key", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = frontier if seen is None else seen.unionByName(frontier)
    dead = marked.where("called").select("key", "node")
    if seen is not None:
        dead = dead.join(seen.hint("merge"), ["key", "node"], "left_anti")
    return dead.join(entries.select("key").distinct().hint("merge"), "key", "left_semi")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer, tier): the order in which nodes can be taken when whatever they lead to comes first.

    Layer 0 leads nowhere; a layer is peeled off per round. What is left on cycles, or before them, has a null layer.
    Tiers: LEAF leads nowhere, ROOT is led to by nothing, MIDDLE both. Edges of a node to itself count as cycles.
    """
    n = nodes.select("node").where("node is not null").distinct()
    e = durable(edges.select("src", "dst").distinct().join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    out_of, into = e.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(True)), e.select(F.col("dst").alias("node")).distinct().withColumn("into", F.lit(True))
    base = durable(n.join(out_of, "node", "left").join(into, "node", "left").select("node", F.when(F.col("out").isNull(), "LEAF").when(F.col("into").isNull(), "ROOT").otherwise("MIDDLE").alias("tier")))
    left, parts, layer = e, [], 0
    waiting = base.select("node")
    while True:
        ready = durable(waiting.join(left.select(F.col("src").alias("node")), "node", "left_anti").withColumn("layer", F.lit(layer)))
        if ready.isEmpty():
            break
        parts.append(ready)
        left = durable(left.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        waiting = durable(waiting.join(ready, "node", "left_anti"))
        layer += 1
    if not parts:
        return base.select("node", F.lit(None).cast("int").alias("layer"), "tier")
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    return base.join(done, "node", "left").select("node", "layer", "tier")
