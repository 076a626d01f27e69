"""Hash-based change detection and keyed completion over state frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTIAL = "partial:"


def changed(now: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``now`` (keys, hash) that the state doesn't hold with the same hash; a partial mark never equals a hash."""
    known = state.select(*keys, F.col("hash").alias("__hash"))
    return now.join(known, keys, "left").where(~F.col("hash").eqNullSafe(F.col("__hash"))).drop("__hash")


def mark(state: DataFrame, done: DataFrame, keys: list[str], partial: bool = False) -> DataFrame:
    """The state with ``done`` (keys, hash) over it."""
    new = done.select(*keys, (F.concat(F.lit(PARTIAL), "hash") if partial else F.col("hash")).alias("hash"))
    return state.select(*keys, "hash").join(new, keys, "left_anti").unionByName(new)


def clear(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The state without the given keys."""
    return state.join(gone.select(*keys).distinct(), keys, "left_anti")


def complete(parts: DataFrame, key: str, index: str, total: str) -> DataFrame:
    """(key, parts, expected, complete): a key is complete when it has all indexes 0 .. total - 1; repeated parts count once."""
    return (
        parts.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count_distinct(F.when((F.col(index) >= 0) & (F.col(index) < F.col(total)), F.col(index))).alias("parts"), F.max(total).alias("expected"))
        .withColumn("complete", F.coalesce(F.col("parts") == F.col("expected"), F.lit(False)))
    )


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``; one map-side combined aggregation, no window."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"__{c}") for c in rest])).alias("__b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__b.__{c}").alias(c) for c in rest])


def calibration(samples: DataFrame, key: str, seq: str, estimated: str, actual: str, last: int = 200) -> DataFrame:
    """``samples`` with ``factor``: the mean of actual over estimated in the last so many samples of the key, this one included; samples without an estimate don't count."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(1 - last, 0)
    return samples.withColumn("factor", F.avg(F.when(F.col(estimated) > 0, F.col(actual) / F.col(estimated))).over(w))


def cached(paths: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): ``paths`` (path, hash) that ``store`` (path, hash, kind, confidence) knows under the same hash, with
    what it knows, and the others; a null hash is never a hit."""
    known = store.select("path", F.col("hash").alias("__hash"), "kind", "confidence")
    joined = paths.select("path", "hash").join(known, "path", "left").withColumn("__hit", F.coalesce(F.col("hash") == F.col("__hash"), F.lit(False)))
    return joined.where("__hit").select("path", "hash", "kind", "confidence"), joined.where("not __hit").select("path", "hash")


def store_results(store: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk results (path, pass, chunk, total, hash, result) with ``new`` over it, one per (path, pass, chunk)."""
    columns = ["path", "pass", "chunk", "total", "hash", "result"]
    latest = new.select(*columns).groupBy("path", "pass", "chunk").agg(F.max(F.struct("total", "hash", "result")).alias("v")).select("path", "pass", "chunk", "v.*")
    return store.select(*columns).join(latest, ["path", "pass", "chunk"], "left_anti").unionByName(latest)


def load_results(store: DataFrame, path: str, number: int) -> DataFrame:
    """What is stored of a file's pass, in the order of its chunks."""
    return store.where((F.col("path") == path) & (F.col("pass") == number)).orderBy("chunk")
