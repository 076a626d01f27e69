"""References to records that do not exist: keyed pending-orphan state, advanced period by period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path, written
from .skew import heavy_keys, split_table

KEYS = ["kind", "key"]
FOUND = "found"
#: Keys of a period that are broadcast to the earlier parts; a period that moves more of them is joined by shuffle.
SMALL_KEYS = 50_000


def _folded(parents: DataFrame, by: list[str]) -> DataFrame:
    """One row per key: its first arrival and its last version."""
    return parents.groupBy(*by).agg(F.min("arrived").alias("arrived"), F.max("last").alias("last"))


class OrphanState:
    """References, parents and verdicts as tables of the shared folder, a part per period; a period appends its part.

    ``refs``: ref_id, kind, key, at, hot, period. ``parents``: kind, key, arrived, last, hot, period, a row per key and
    period; over the periods so far they are the parent index. Nothing that stands is written again.
    """

    def __init__(self, refs: DataFrame, parents: DataFrame, heavy: bool = False, sizes: dict[str, int] | None = None):
        """``sizes``: by period, how many rows its two parts have together, so how many keys can move in it at most."""
        self.refs, self.parents, self.heavy, self.sizes = refs, parents, heavy, sizes or {}
        self.periods: list[str] = []
        self.judged: dict[str, int] = {}
        self.folder = fresh_path(refs.sparkSession)

    def advance(self, period: str, count: bool = False) -> None:
        """Take in one period: its new references, and the earlier ones of keys whose parents came, changed or went in it, probe the index.

        A period costs what moved in it: only the keys of its rows are folded out of the index, and only these
        references get a verdict. Where the period's rows are few, their keys are broadcast and earlier parts only
        scanned; else both are joined by shuffle, and references of heavy keys (``hot``; few keys) are looked up by
        broadcast, so no task gets all references of one. ``count`` keeps the number of references judged.
        """
        few = self.sizes.get(period, SMALL_KEYS + 1) <= SMALL_KEYS
        sent = F.broadcast if few else (lambda df: df)
        fresh = self.refs.where(F.col("period") == period)
        new = sent(self.parents.where(F.col("period") == period).select(*KEYS))
        moved = fresh.unionByName(self.refs.where(F.col("period") < period).join(new, KEYS, "left_semi").select(self.refs.columns))
        asked = sent(fresh.select(*KEYS).unionByName(self.parents.where(F.col("period") == period).select(*KEYS)).distinct())
        known = sent(_folded(self.parents.where(F.col("period") <= period).join(asked, KEYS, "left_semi"), [*KEYS, "hot"]))
        if self.heavy and not few:
            cold = moved.where("not hot").join(known.where("not hot").drop("hot"), KEYS, "left")
            met = cold.unionByName(moved.where("hot").join(F.broadcast(known.where("hot").drop("hot")), KEYS, "left"))
        else:
            met = moved.join(known.drop("hot"), KEYS, "left")
        status = F.when(F.col("last").isNull(), "missing").when(F.col("at") < F.col("arrived"), "late").when(F.col("last.deleted_at") <= F.col("at"), "deleted").otherwise(FOUND)
        met.select("ref_id", "kind", "at", status.alias("status")).write.parquet(f"{self.folder}/period={period}")
        self.periods.append(period)
        if count:
            self.judged[period] = self.log().where(F.col("period") == period).count()

    def log(self) -> DataFrame:
        """(ref_id, kind, at, status, period): all verdicts so far."""
        at = self.refs.select("ref_id", "kind", "at").schema
        schema = T.StructType([*at, T.StructField("status", T.StringType()), T.StructField("period", T.StringType())])
        spark = self.refs.sparkSession
        return spark.read.schema(schema).parquet(self.folder) if self.periods else spark.createDataFrame([], schema)

    def verdicts(self) -> DataFrame:
        """(ref_id, kind, at, status) by the latest verdict of each reference."""
        return self.log().groupBy("ref_id").agg(F.max(F.struct("period", "kind", "at", "status")).alias("v")).select("ref_id", "v.kind", "v.at", "v.status")

    def snapshots(self) -> DataFrame:
        """(as_of, kind, month, status, n): the orphans per table and month of the reference as they stood after each period.

        A verdict adds to its group from its period on, and the one it replaces is taken away; what is expanded to
        every period are the groups' counts, not references.
        """
        w = Window.partitionBy("ref_id").orderBy("period")
        moves = self.log().select("ref_id", "kind", F.date_format("at", "yyyy-MM").alias("month"), "status", "period", F.lead("period").over(w).alias("until"))
        both = F.explode(F.array(F.struct(F.col("period").alias("p"), F.lit(1).alias("d")), F.struct(F.col("until").alias("p"), F.lit(-1).alias("d"))))
        steps = moves.where(F.col("status") != FOUND).select("kind", "month", "status", both.alias("x")).where("x.p is not null").groupBy("x.p", "kind", "month", "status").agg(F.sum("x.d").alias("d"))
        run = Window.partitionBy("kind", "month", "status").orderBy("p")
        stood = steps.select("kind", "month", "status", "p", F.sum("d").over(run).alias("n"), F.lead("p").over(run).alias("next"))
        periods = F.array(*[F.lit(p) for p in self.periods]).cast("array<string>")
        during = F.filter(periods, lambda x: (x >= F.col("p")) & F.coalesce(x < F.col("next"), F.lit(True)))
        return stood.where("n > 0").select(F.explode(during).alias("as_of"), "kind", "month", "status", "n")


def open_state(refs: DataFrame, parents: DataFrame) -> tuple[OrphanState, list[str]]:
    """The state before its first period, and the periods (months of arrival in the engine) to advance through.

    ``refs``: ref_id, kind (table referred to), key, at (time of the reference), loaded (time it came in).
    ``parents``: kind, key, arrived (null: always there), stamp (version), deleted_at, seen (time it came in).
    Repeated references and parents count once. A reference with a null ref_id or key drops out; null times of
    arrival in the engine count as the earliest period. Parents nobody refers to can resolve nothing and are left out
    by a semi-join on the distinct keys.
    """
    period = lambda c: F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("0000-00"))
    once = refs.where("ref_id is not null and key is not null").groupBy("ref_id", *KEYS, "at").agg(period(F.min("loaded")).alias("period"))
    r = written(once.hint("rebalance", "period"), by="period")
    # versions of a key within a period fold into one row before anything moves
    p = parents.select(*KEYS, "arrived", F.struct("stamp", "deleted_at").alias("last"), period(F.col("seen")).alias("period"))
    p = _folded(p.join(r.select(*KEYS).distinct(), KEYS, "left_semi"), [*KEYS, "period"])
    p = written(p.hint("rebalance", "period"), by="period")
    heavy = heavy_keys(r, KEYS)
    table = split_table(refs.sparkSession, r, KEYS, heavy, 1) if heavy else None

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("hot", F.lit(False)) if table is None else df.join(table, KEYS, "left").withColumn("hot", F.col("__splits").isNotNull()).drop("__splits")

    # months: bounded by the calendar, not by the data
    sizes = {m: n for m, n in r.select("period").unionByName(p.select("period")).groupBy("period").count().collect()}
    return OrphanState(marked(r), marked(p), bool(heavy), sizes), sorted(sizes)


def track(refs: DataFrame, parents: DataFrame, count: bool = False) -> OrphanState:
    """The state after all periods; its ``verdicts`` and ``snapshots`` are the results. Without references there are none."""
    state, periods = open_state(refs, parents)
    for period in periods:
        state.advance(period, count)
    return state
