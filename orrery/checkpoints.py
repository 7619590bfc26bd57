"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; made up only where the session names none, as on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    at = sc._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="orrery-checkpoints-"))
        at = sc._jsc.sc().getCheckpointDir()
    return named or at.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Written out at once; a lost executor then loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitioned(df: DataFrame, n: int, by: str) -> DataFrame:
    """A table that is written already, written out in n partitions by a column, which later joins know of: they don't shuffle it again."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    # an adaptive plan doesn't tell how its rows are partitioned; here it has nothing to decide, as this is a mere shuffle
    spark.conf.set(key, "false")
    try:
        return checkpointed(df.repartition(n, by))
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in the shared folder: compressed, and read by columns; ``discarded`` deletes it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def discarded(*frames: DataFrame | None) -> None:
    """Delete tables of ``stored`` that nothing reads any more, and have Spark drop shuffle files that nothing refers to."""
    for df in frames:
        if at := getattr(df, "stored_at", None):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Have the collectors of driver and executors run.

    Spark then deletes the shuffle files of finished steps (it needs a moment
    for it), and the executors give back memory that they don't use; otherwise
    their heaps stay as large as the largest step made them.
    """
    # this also makes the bus of events let go of the last query, and with it of its shuffle files
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, executors, 1, executors).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
