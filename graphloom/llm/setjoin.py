"""All similar pairs between set-valued records, by T-occurrence merging of inverted lists."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from ..operators.lookups import lookup

#: Members of one block of a token's list; longer lists are cut into blocks that meet pair by pair.
BLOCK = 2_000


def occurring(lists: list[list[int]], t: int, start: int = 0) -> list[tuple[int, int]]:
    """(id, count) of the ids at or after ``start`` that stand on at least ``t`` of the sorted ``lists``.

    The longest lists are only searched: an id must stand on t - L of the others first, which are merged by a heap. When
    the heap's top can't reach that, t - L - 1 lists are popped and skip to the next possible id by binary search.
    """
    if t < 1 or len(lists) < t:
        return []
    lists = sorted(lists, key=len)
    apart = min(t - 1, int(t / (0.01 * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = (lists[:-apart], lists[-apart:]) if apart else (lists, [])
    need = t - apart
    at = [bisect_left(x, start) for x in short]
    heap = [(x[p], i) for i, (x, p) in enumerate(zip(short, at)) if p < len(x)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        n = len(popped)
        if n >= need:
            for k, x in enumerate(long):
                if n + len(long) - k < t:
                    break
                p = bisect_left(x, top)
                n += p < len(x) and x[p] == top
            if n >= t:
                found.append((top, n))
            to = top + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            to = max(top + 1, heap[0][0])
        for i in popped:
            p = bisect_left(short[i], to, at[i])
            at[i] = p
            if p < len(short[i]):
                heapq.heappush(heap, (short[i][p], i))
    return found


def _joined(members: list[tuple], token: int, crossing: bool, threshold: float) -> list[tuple]:
    """Pairs of one token's block pair. members: (size, id, side, values in global order), sorted by size."""
    index: tuple[dict[int, list[int]], ...] = ({}, {})
    sizes, out = [m[0] for m in members], []
    for k, (n, rid, side, values) in enumerate(members):
        theirs = index[1 - side] if crossing else index[0]
        mine = index[side] if crossing else index[0]
        lists = [theirs[v] for v in values if v in theirs]
        least = math.ceil(threshold * n - 1e-9)
        for other, c in occurring(lists, least, bisect_left(sizes, least)):
            m, oid, _, _ = members[other]
            if c < threshold * (n + m - c) - 1e-9:
                continue
            for v in values:  # the first shared value in global order: every pair comes out of one list only
                x = theirs.get(v)
                if x and (p := bisect_left(x, other)) < len(x) and x[p] == other:
                    break
            if v == token:
                out.append((rid, oid, c, n + m - c) if rid < oid else (oid, rid, c, n + m - c))
        for v in values:
            mine.setdefault(v, []).append(k)
    return out


def _joiner(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            a, b, c, d = zip(*rows) if rows else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.int32()), pa.array(d, pa.int32())], ["a", "b", "overlap", "together"])

        group, members, out = None, [], []
        for batch in batches:
            for token, lo, hi, block, n, rid, values in zip(*(x.to_pylist() for x in batch.columns)):
                if (token, lo, hi) != group:
                    if len(members) > 1:
                        out += _joined(members, group[0], group[1] != group[2], threshold)
                        if len(out) > 10_000:
                            yield emit(out)
                            out = []
                    group, members = (token, lo, hi), []
                members.append((n, rid, int(block == hi and lo != hi), values))
        if len(members) > 1:
            out += _joined(members, group[0], group[1] != group[2], threshold)
        yield emit(out)

    return run


def classes(df: DataFrame, key: str, values: str, least: int = 1) -> DataFrame:
    """(key, class, n, set): the record's set as sorted 64-bit hashes and a 128-bit digest that equal sets share.

    Null values don't count, repeated values count once, records with fewer than ``least`` values drop out, and so do
    null keys and null arrays. Repeated rows count once.
    """
    hashed = F.array_sort(F.array_distinct(F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))
    sets = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), hashed.alias("set")).where(F.size("set") >= max(1, least)).distinct()
    return sets.select("key", F.unhex(F.md5(F.array_join(F.col("set").cast("array<string>"), ",").cast("binary"))).alias("class"), F.size("set").alias("n"), "set")


def similar(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, overlap, together): pairs of classes whose sets have intersection / union >= ``threshold``, a < b.

    ``sets`` from ``classes``; each class takes part once, however many records share it. Values are ordered by how
    many classes hold them, rarest first; two sets similar enough share a value among the first
    n - ceil(threshold * n) + 1 of both, so a class is listed under these values only. Each list is joined by itself,
    probing its inverted lists for ids that occur often enough. A long list is cut into blocks by hash, and every pair
    of blocks is a task of its own with at most twice ``block`` members or so: nothing is capped. A pair comes out of
    the list of its first shared value only, so no pair appears twice.
    """
    reps = durable(sets.select("class", "n", "set").dropDuplicates(["class"]))
    held = reps.select("class", "n", F.explode("set").alias("v"))
    often = durable(held.groupBy("v").agg(F.count(F.lit(1)).alias("df")))
    total = often.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    ordered = lookup(held, often, ["v"], "inner", count="df", total=total).groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("x"))
    ordered = durable(ordered.select("class", "n", F.transform("x", lambda s: s["v"]).alias("set")))
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)).cast("int") + 1
    listed = ordered.select("class", "n", "set", F.explode(F.slice("set", F.lit(1), first)).alias("token"))
    lengths = durable(listed.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    entries = lengths.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    spread = lookup(listed, lengths, ["token"], "inner", count="m", total=entries)
    k = F.ceil(F.col("m") / F.lit(block)).cast("int")
    mine = F.pmod(F.hash("class"), k)
    laid = spread.withColumn("k", k).withColumn("block", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    laid = laid.select("token", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi"), "block", "n", "class", "set")
    laid = laid.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "class")
    return laid.mapInArrow(_joiner(threshold), "a binary, b binary, overlap int, together int")


def expand(sets: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, overlap, together): the pairs of records behind the pairs of classes, and the pairs inside a class, a < b.

    This is as large as the answer itself; ``links`` says the same in one row per record. A class of many records is cut
    into blocks by hash, and every pair of blocks is joined apart, so a class never sits in one task.
    """
    sizes = durable(sets.groupBy("class").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n")))
    blocks = lambda m: F.ceil(m / F.lit(block)).cast("int")
    numbered = lookup(sets.select("key", "class"), sizes.drop("n"), ["class"], "inner", count="m").withColumn("k", blocks(F.col("m")))
    members = durable(numbered.select("key", "class", "k", F.pmod(F.xxhash64("key"), F.col("k")).cast("int").alias("at")))
    spans = lambda c: F.sequence(F.lit(0), blocks(F.col(c)) - 1)
    met = pairs.join(sizes.select(F.col("class").alias("a"), F.col("m").alias("ma")), "a").join(sizes.select(F.col("class").alias("b"), F.col("m").alias("mb")), "b")
    across = met.select("a", "b", "overlap", "together", F.explode(spans("ma")).alias("i"), "mb").select("a", "b", "overlap", "together", "i", F.explode(spans("mb")).alias("j"))
    alone = sizes.where("m > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.col("n").alias("overlap"), F.col("n").alias("together"), F.explode(spans("m")).alias("i"), "m")
    alone = alone.select("a", "b", "overlap", "together", "i", F.explode(spans("m")).alias("j")).where("i <= j")
    left, right = members.select(F.col("key").alias("ka"), F.col("class").alias("a"), F.col("at").alias("i")), members.select(F.col("key").alias("kb"), F.col("class").alias("b"), F.col("at").alias("j"))
    every = across.unionByName(alone).join(left, ["a", "i"]).join(right, ["b", "j"]).where((F.col("a") != F.col("b")) | (F.col("i") < F.col("j")) | (F.col("ka") < F.col("kb")))
    return every.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "overlap", "together")


def links(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, first, links): one row per record, with the least key among the equal sets, which names its class, and the
    number of records similar to it, equal ones included."""
    size = durable(sets.groupBy("class").agg(F.count(F.lit(1)).alias("records"), F.min("key").alias("first")))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = both.join(size.select(F.col("class").alias("b"), "records"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("records").alias("beyond"))
    per = size.join(beyond, "class", "left").select("class", "first", F.col("records").alias("__n"), (F.col("records") - 1 + F.coalesce("beyond", F.lit(0))).alias("links"))
    return lookup(sets.select("key", "class"), durable(per), ["class"], "inner", count="__n").select("key", "first", "links")
