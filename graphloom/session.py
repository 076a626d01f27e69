"""Session helpers: table access and durable cuts of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application; they may have neither its folder nor its path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Parquet carries the schema, so nothing is inferred."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of this application. The cluster names its shared folder in spark.checkpoint.dir; only a local master
    (tests, a laptop) may leave that unset and gets one of its own, which goes when the driver ends."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession) -> str:
    """A path of its own in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: compressed, read by column, and pruned by ``by``."""
    spark = df.sparkSession
    path = fresh_path(spark)
    out = df.write.partitionBy(by) if by else df.write
    out.parquet(path)
    schema = df.schema if by is None else T.StructType([f for f in df.schema if f.name != by] + [df.schema[by]])
    return spark.read.schema(schema).parquet(path)


def durable(df: DataFrame, laid: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: no lineage to replay when an executor is lost.

    ``laid`` keeps the frame's partitioning and order known to later plans, so that joins on them don't shuffle it
    again; adaptive planning forgets both, and is off while such a frame is written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not laid:
        return df.checkpoint(eager=True)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
