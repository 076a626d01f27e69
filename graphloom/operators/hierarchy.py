"""Parent-child links to full hierarchies: parents from levels, level-wise frontier joins, ancestor pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .skew import heavy_keys, replicated, salted

#: Lines of one group that are nested as one block; longer groups are nested in blocks and then joined up.
BLOCK_LINES = 1_000_000
#: Distinct levels there may be where groups have several blocks: each costs a column there. Those of data items are 1 to 49.
MOST_LEVELS = 128
#: Edges a partition should hold at most, and at least before another partition is worth its overhead.
MOST_EDGES, LEAST_EDGES = 2_000_000, 50_000
#: Rounds at width 1 and at the next width before deeper trees are climbed in wider steps, the factor between widths, and the widest.
ROUNDS, MORE_ROUNDS, WIDER, WIDEST = 6, 12, 8, 64


def _nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nearest earlier smaller level over rows sorted by (grp, block, line, key), a whole batch at a time.

    For every level of the batch, a running maximum gives the place of the last row of a smaller level; a row takes the
    one before its line began, if that lies in its own block. What a later batch can need of a block is the last row
    of each level, on the last line and before it: these stand before the next batch as context.
    """
    kept: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        n, grp = batch.num_rows, batch.column(0)
        block, line, level, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 5))
        fresh = np.ones(n, bool)
        fresh[1:] = pc.not_equal(grp.slice(1), grp.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
        c = 0
        if kept is not None and kept[0] == (grp[0].as_py(), int(block[0])):
            c = len(kept[1])
            line, level, key = (np.concatenate(x) for x in zip(kept[1:], (line, level, key)))
            fresh = np.concatenate([np.arange(c) == 0, [False], fresh[1:]])
        at = np.arange(c + n)
        first = fresh.copy()  # of a line
        first[1:] |= line[1:] != line[:-1]
        begin, row = np.maximum.accumulate(np.where(fresh, at, 0)), np.maximum.accumulate(np.where(first, at, 0))
        found = np.full(c + n, -1)
        for lv in np.unique(level[c:]):
            mine = np.nonzero(level == lv)[0]
            last = np.maximum.accumulate(np.where(level < lv, at, -1))
            found[mine] = np.where(row[mine] > 0, last[row[mine] - 1], -1)
        found[found < begin] = -1
        once = first.copy()
        once[1:] |= key[1:] != key[:-1]
        shown = np.nonzero(once[c:])[0]
        parent = found[c:][shown]
        took = pa.array(shown)
        yield pa.RecordBatch.from_arrays(
            [grp.take(took), pa.array(block[shown]), pa.array(level[c:][shown]), pa.array(key[c:][shown]), pa.array(np.where(parent < 0, 0, key[parent]), mask=parent < 0)], ["grp", "block", "level", "key", "parent"]
        )
        ends = [_last_of_levels(level, x, y) for x, y in ((begin[-1], row[-1]), (row[-1], c + n))]
        ends = np.concatenate(ends)
        kept = ((grp[n - 1].as_py(), int(block[n - 1])), line[ends], level[ends], key[ends])


def _last_of_levels(level: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Places of the last row of each level in [lo, hi), in order."""
    back = level[lo:hi][::-1]
    return np.sort(hi - 1 - np.unique(back, return_index=True)[1])


def nest_by_level(df: DataFrame, group: str, line: str, level: str, key: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(key, parent): the parent is the nearest earlier row by ``line`` in the same ``group`` with a smaller ``level``.

    One sort by line; then running maxima over whole Arrow batches. Groups are nested in blocks of ``block_lines``
    lines, so one group never has to fit one task; what a block leaves open is resolved from the last row per level of
    the blocks before it. Rows of one line don't nest in each other; of two rows of a level on a line the larger key is
    the later. Repeated rows count once. A row whose group, line or level is null has no parent and is nobody's parent;
    a row with a null key drops out. Groups of several blocks may have MOST_LEVELS distinct levels. An empty frame gives
    no rows; other columns are ignored.
    """
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(line).cast("long").alias("line"), F.col(level).cast("int").alias("level"), F.col(key).cast("long").alias("key")).where("key is not null")
    whole = rows.where("grp is not null and line is not null and level is not null")
    loose = rows.where("grp is null or line is null or level is null").select("key", F.lit(None).cast("long").alias("parent")).distinct()
    low, high = whole.agg(F.min("line"), F.max("line")).first()
    blocked = whole.withColumn("block", F.floor(F.col("line") / F.lit(block_lines)).cast("long")).select("grp", "block", "line", "level", "key")
    laid = blocked.repartition("grp", "block").sortWithinPartitions("grp", "block", "line", "key")
    nested = laid.mapInArrow(_nest, "grp string, block long, level int, key long, parent long")
    if low is None or low // block_lines == high // block_lines:
        return nested.select("key", "parent").unionByName(loose)
    nested = durable(nested)
    levels = sorted(r[0] for r in blocked.select("level").distinct().limit(MOST_LEVELS + 1).collect())
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels")
    before = Window.partitionBy("grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tails = blocked.groupBy("grp", "block").agg(*[F.max(F.when(F.col("level") == v, F.struct("line", "key"))).alias(f"t{v}") for v in levels])
    carried = tails.select("grp", "block", *[F.max(f"t{v}").over(before).alias(f"c{v}") for v in levels])
    nearest = F.greatest(*[F.when(F.col("level") > v, F.col(f"c{v}")) for v in levels], F.lit(None), F.lit(None))["key"]
    opened = nested.where("parent is null").join(carried, ["grp", "block"], "left").select("key", nearest.alias("parent"))
    return nested.where("parent is not null").select("key", "parent").unionByName(opened).unionByName(loose)


def _chained(links: DataFrame, width: int, far: Column, paths: bool) -> DataFrame:
    """(scope, parent, child, hops): all ancestor pairs at distances 1 to ``width``, by doubling; ``hops`` leads from below parent to child."""
    pairs, reach = links, 1
    spark_width = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while reach < width:
        heavy = heavy_keys(pairs, ["scope", "parent"])
        lower = salted(pairs, ["scope", "parent"], heavy, spark_width, F.col("child")).select("scope", F.col("parent").alias("mid"), "__salt", F.col("child").alias("low"), F.col("hops").alias("rest"))
        upper = replicated(pairs.where(far == reach).select("scope", "parent", F.col("child").alias("mid"), "hops"), ["scope", "mid"], heavy, spark_width)
        longer = upper.join(lower, ["scope", "mid", "__salt"]).select("scope", "parent", F.col("low").alias("child"), (F.concat("hops", "rest") if paths else F.col("hops") + F.col("rest")).alias("hops"))
        pairs, reach = durable(pairs.unionByName(longer)), 2 * reach
    return pairs


def forest(links: DataFrame, node: str, parent: str, unique: bool = False, complete: bool = False, paths: bool = True, scope: str | None = None) -> DataFrame:
    """(node, root, depth, parent, path): every node's place in its tree.

    Level-wise frontier joins from the roots: a level holds the children of the level before, so each node is reached
    once and a round shuffles its frontier only; the links are laid out by parent once and stay where they are. Where
    trees go deeper than ROUNDS levels, the links not used up are chained to ancestor pairs of up to WIDER times the
    distance, and a round takes that many levels at once. Children of a heavy parent are spread by salt. ``path`` runs
    from the root to the node. Nodes that no root reaches hang on a loop or are in one: root, depth and path are null.
    Without ``paths`` the columns parent and path are left out, and a row costs the same at every depth. ``scope`` names
    a column of few values, kinds of hierarchy with node names of their own, which are climbed together; it comes back
    as the first column.

    Repeated links count once; of several parents the smallest holds (``unique`` says that neither occurs). A parent
    without a row of its own doesn't count, its children are roots (``complete`` says that there is none). A node
    that is its own parent is a loop. Rows with a null node drop out; an empty frame gives no rows.
    """
    spark = links.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, far = ["path"] if paths else [], F.size("hops") if paths else F.col("hops")
    nodes = links.select((F.col(scope) if scope else F.lit(0)).alias("scope"), F.col(node).alias("node"), F.col(parent).alias("parent")).where("node is not null")
    if not unique:
        nodes = nodes.groupBy("scope", "node").agg(F.min("parent").alias("parent"))
    nodes = durable(nodes)
    if not complete:
        known = nodes.select("scope", F.col("node").alias("parent"), F.lit(True).alias("known"))
        nodes = durable(nodes.join(known, ["scope", "parent"], "left").select("scope", "node", F.expr("if(known, parent, null)").alias("parent")))
    sizes = {r[0]: (r[1], r[2]) for r in nodes.groupBy("scope").agg(F.count(F.lit(1)), F.count("parent")).collect()}
    linked = sum(b for _, b in sizes.values())
    left = {k: b for k, (_, b) in sizes.items()}
    plain = nodes.where("parent is not null").select("scope", "parent", F.col("node").alias("child"), (F.array("node") if paths else F.lit(1)).alias("hops"))

    def lay(pairs: DataFrame, n: int) -> tuple[DataFrame, list[tuple]]:
        parts = max(1, min(math.ceil(n / LEAST_EDGES), max(width, math.ceil(n / MOST_EDGES))))
        heavy = heavy_keys(pairs, ["scope", "parent"], total=n)
        spread = salted(pairs, ["scope", "parent"], heavy, width, F.col("child"))
        return durable(spread.repartition(parts, "scope", "parent", "__salt").sortWithinPartitions("scope", "parent", "__salt"), laid=True), heavy

    level = nodes.where("parent is null").select("scope", "node", F.col("node").alias("root"), F.lit(0).alias("depth"), *([F.array("node").alias("path")] if paths else []))
    levels, fresh, at, step, rounds = [level], [level], 0, 1, 0
    pairs, heavy = lay(plain, linked) if linked else (plain, [])
    while any(left.values()) and level is not None:
        if rounds == (ROUNDS if step == 1 else MORE_ROUNDS) and step < WIDEST:
            # the links as laid out stay where they are; only what is used up moves
            gone = _union([x.where(F.col("depth") < at).select("scope", F.col("node").alias("parent")) for x in fresh])
            one = pairs.where(far == 1) if step > 1 else pairs
            plain = durable(one.join(replicated(gone, ["scope", "parent"], heavy, width), ["scope", "parent", "__salt"], "left_anti").drop("__salt"))
            step, rounds, fresh = min(step * WIDER, WIDEST), 0, [level]
            chained = _chained(plain, step, far, paths)
            pairs, heavy = lay(chained, chained.count())
        ends = replicated(level.select("scope", F.col("node").alias("parent"), "root", *path), ["scope", "parent"], heavy, width)
        longer = [F.concat("path", "hops").alias("path")] if paths else []
        met = durable(pairs.join(ends, ["scope", "parent", "__salt"]).select("scope", F.col("child").alias("node"), "root", (F.lit(at) + far).alias("depth"), *longer))
        at, rounds = at + step, rounds + 1
        counts = met.groupBy("scope").agg(F.count(F.lit(1)), F.count(F.when(F.col("depth") == at, 1))).collect()
        for kind, n, _ in counts:
            left[kind] -= n
        if counts:
            levels.append(met)
            fresh.append(met)
        level = met.where(F.col("depth") == at) if any(r[2] for r in counts) else None
    shown = [F.col("scope").alias(scope)] if scope else []
    above = [F.when(F.col("depth") > 0, F.element_at("path", -2)).alias("parent"), "path"] if paths else []
    placed = _union(levels).select("scope", "node", "root", "depth", *above)
    lost_in = [k for k, n in left.items() if n]
    if lost_in:
        within = lambda df: df.where(F.coalesce(F.col("scope").isin(lost_in), F.lit(None in lost_in)))
        reached = placed.select(F.col("scope").alias("s"), F.col("node").alias("k"))
        lost = within(nodes).join(reached, F.col("scope").eqNullSafe(F.col("s")) & (F.col("node") == F.col("k")), "left_anti")
        nowhere = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("root", "depth")]
        placed = placed.unionByName(lost.select("scope", "node", *nowhere, *(["parent", F.lit(None).cast(placed.schema["path"].dataType).alias("path")] if paths else [])))
    return placed.select(*shown, *placed.columns[1:]).coalesce(max(width, 2))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def ancestor_pairs(placed: DataFrame, scope: str | None = None) -> DataFrame:
    """(ancestor, descendant, distance) from ``forest`` with paths: one row per node and proper ancestor, so all descendants of every node.

    Nodes on loops have no path and give no pairs. ``scope`` is kept as the first column.
    """
    kept = [scope] if scope else []
    up = placed.where("depth > 0").select(*kept, F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return up.where("at < depth").select(*kept, "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
