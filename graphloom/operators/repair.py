"""Repairs as pure functions from frames to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components


def mark_external(programs: DataFrame, calls: DataFrame) -> DataFrame:
    """``programs`` (id, file_path, language, external): one without a source that something calls is external, its language EXTERNAL if it has none."""
    called = calls.select(F.col("dst").alias("id")).distinct().withColumn("__called", F.lit(True))
    hit = F.col("file_path").isNull() & F.coalesce(F.col("__called"), F.lit(False))
    return (
        programs.join(called, "id", "left")
        .withColumn("external", F.coalesce(F.col("external"), F.lit(False)) | hit)
        .withColumn("language", F.when(hit, F.coalesce("language", F.lit("EXTERNAL"))).otherwise(F.col("language")))
        .drop("__called")
    )


def clear_external(programs: DataFrame, memberships: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """External programs without scores and domains: (programs, memberships)."""
    cleared = programs.withColumns({c: F.when(~F.coalesce(F.col("external"), F.lit(False)), F.col(c)) for c in columns})
    return cleared, memberships.join(programs.where("external").select(F.col("id").alias("program")), "program", "left_anti")


def revive(programs: DataFrame, calls: DataFrame, runs: DataFrame) -> DataFrame:
    """``programs`` (id, file_path, dead): one that a job runs or a program with a source calls isn't dead."""
    sourced = programs.where("file_path is not null").select(F.col("id").alias("src"))
    live = calls.join(sourced, "src", "left_semi").select(F.col("dst").alias("id")).unionByName(runs.select(F.col("program").alias("id"))).distinct().withColumn("__live", F.lit(True))
    return programs.join(live, "id", "left").withColumn("dead", F.col("dead") & F.col("__live").isNull()).drop("__live")


def unmark(paragraphs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``paragraphs`` (program, name, reachable): those in ``verdicts`` (program, name) are reachable."""
    v = verdicts.select("program", "name").distinct().withColumn("__v", F.lit(True))
    return paragraphs.join(v, ["program", "name"], "left").withColumn("reachable", F.col("reachable") | F.col("__v").isNotNull()).drop("__v")


def link_cards(cards: DataFrame, files: DataFrame) -> DataFrame:
    """(dd, file, method): ``cards`` (dd, name, dsname) to ``files`` (file): by equal name first, then, for cards still
    without a link, by a part of the data set name after its first full stop. Parts are exploded, so both are equi-joins."""
    f = files.select("file", F.upper("file").alias("__f")).distinct()
    first = cards.select("dd", F.upper("name").alias("__f")).join(f, "__f").select("dd", "file", F.lit("name").alias("method"))
    rest = cards.join(first.select("dd"), "dd", "left_anti")
    parts = rest.select("dd", F.explode(F.expr("slice(split(dsname, '[.]'), 2, 1000)")).alias("file"))
    return first.unionByName(parts.join(files.select("file"), "file").select("dd", "file", F.lit("dsname").alias("method"))).distinct()


def merge_domains(memberships: DataFrame, pairs: DataFrame) -> DataFrame:
    """``memberships`` (program, domain, ...) with the domains of ``pairs`` (a, b), and chains of them of any length, made
    one: of each connected component the largest, then the shortest, then the first by name is kept; a program belongs
    to it once."""
    sizes = memberships.groupBy("domain").agg(F.count_distinct("program").alias("n"))
    met = components(pairs, "a", "b").select(F.col("node").alias("domain"), "component")
    best = met.join(sizes, "domain").groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), F.length("domain").alias("l"), "domain")).alias("b"))
    kept = met.join(best, "component").select("domain", F.col("b.domain").alias("__keep"))
    return memberships.join(kept, "domain", "left").select("program", F.coalesce("__keep", "domain").alias("domain")).distinct()


def reassign(memberships: DataFrame, moves: DataFrame) -> DataFrame:
    """All domains of the programs in ``moves`` (program, domain) replaced by the one given there."""
    new = moves.select("program", "domain").distinct()
    return memberships.select("program", "domain").join(new.select("program"), "program", "left_anti").unionByName(new)
