"""Mixing sources to target weights."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import tokens
from ..session import durable

#: Where the public vocabulary lies on the driver; a parameter of every call. Executors get it from there.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's text is cut into words before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows a prefix-sum bucket should hold.
BUCKET_ROWS = 50_000
#: A table of targets has one row per source and is broadcast; more sources than this are refused.
MOST_SOURCES = 100_000


def _counter(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            key, source, text = batch.columns
            sizes = [len(bpe.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in text]
            yield pa.RecordBatch.from_arrays([key, source, pa.array(sizes, pa.int64())], ["doc_id", "source", "size"])

    return run


def sized(docs: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(doc_id, source, size): tokens of a public byte-level BPE, or of the project's estimate where ``vocabulary`` is None. Null texts have size 0."""
    if vocabulary is None:
        return docs.select("doc_id", "source", tokens(F.col("text")).alias("size"))
    docs.sparkSession.sparkContext.addFile(os.path.realpath(vocabulary))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(_counter(os.path.basename(os.path.realpath(vocabulary))), "doc_id long, source string, size long")


def budgets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: tokens there are, budget, whole epochs, and the rest to be cut from one more epoch.

    ``docs`` from ``sized``; the budget is target_share of the tokens of all documents, of sources without a target
    too. A source without documents has 0 tokens. Targets with a null source or share are ignored.
    """
    per = docs.groupBy("source").agg(F.sum("size").alias("tokens"))
    total = docs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    goal = targets.where("source is not null and target_share is not null").select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).distinct()
    budget = F.floor(F.col("target_share") * F.lit(total)).cast("long")
    epochs = F.least(F.col("max_repeats"), F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0))).cast("int")
    return (
        goal.join(per, "source", "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("all_tokens", F.lit(total).cast("long"))
        .withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)).cast("long"))
    )


def mix(docs: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, copies): how often each document goes into the mix; documents of no target source are left out.

    Documents get hash-random keys and are range-sorted within their source by them: the keys are uniform, so ranges of
    equal width are the buckets, named by the key itself and the same when a task runs again. Token sums per (source,
    bucket) give every bucket its offset, a running sum inside the bucket the rest: a distributed prefix sum in which
    no source ever sits in one task. A source is cut at its budget: the prefix that fits, never more. Documents of
    size 0 go in while the prefix before them fits.
    """
    if plan.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    n = docs.count()
    bits = min(40, max(0, math.ceil(math.log2(max(1, n) / BUCKET_ROWS))))
    key = F.xxhash64("doc_id", F.lit(seed))
    bucket = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    keyed = docs.join(F.broadcast(plan.select("source", "epochs", "rest")), "source").withColumn("__key", key).withColumn("__bucket", bucket)
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum")).select("source", "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("source", "__bucket").orderBy("__key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.join(offsets, ["source", "__bucket"]).withColumn("__prefix", F.col("__offset") + F.sum("size").over(inside))
    copies = F.col("epochs") + ((F.col("__prefix") <= F.col("rest")) & (F.col("rest") > 0)).cast("int")
    return run.select("doc_id", "source", "size", copies.alias("copies")).where("copies > 0")


def repeated(mixed: DataFrame) -> DataFrame:
    """(doc_id, source, epoch): one row per use of a document."""
    return mixed.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"))


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: tokens, budget, tokens taken and the actual share of the mix, beside the target.

    ``short``: the mix holds every document of the source max_repeats times, and that is less than its target share of
    the tokens of all documents. A source without documents is short of any target.
    """
    whole = plan.join(mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.sum("size").alias("used"), F.min("copies").alias("least")), "source", "left")
    taken = durable(whole.withColumn("taken", F.coalesce("taken", F.lit(0)))).withColumn("spent", (F.coalesce("used", F.lit(0)) == F.col("tokens")) & F.coalesce(F.col("least") == F.col("max_repeats"), F.lit(True)))
    total = taken.agg(F.coalesce(F.sum("taken"), F.lit(0))).first()[0]
    actual = F.when(F.lit(total) > 0, F.round(F.col("taken") / F.lit(max(1, total)), 6))
    short = F.col("spent") & (F.col("taken") < F.col("target_share") * F.col("all_tokens"))
    return taken.select("source", "target_share", "max_repeats", "tokens", "budget", "taken", actual.alias("actual_share"), short.alias("short"))
