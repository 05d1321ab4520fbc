"""Cutting lineage with reliable checkpoints and stored tables that survive the loss of an executor."""

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only on a local master (tests) make one where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def pinned(df: DataFrame) -> DataFrame:
    """A materialised copy: computed once, read by every later branch."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STEPS: list[list[DataFrame]] = []


def stored(df: DataFrame) -> DataFrame:
    """Like ``pinned`` for tables with a row per file: compressed columns instead of serialised rows, of which later stages read
    those they need.  The shuffle files behind it go as soon as it is written."""
    if getattr(df, "_stored_at", None):
        return df
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = os.path.join(top, f"stored-{uuid.uuid4().hex}")
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _STEPS:
        _STEPS[-1].append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Removes the table behind what ``stored`` returned; for tables that nothing lazy reads any more."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """``stored(build())``; the tables that ``build`` stored on its way go once the result is written."""
    _STEPS.append([])
    try:
        out = stored(build())
    finally:
        steps = _STEPS.pop()
    for table in steps:
        if table is not out:
            dropped(table)
    if _STEPS:
        _STEPS[-1].append(out)
    return out


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash the rows over all cores ahead of a stage that does much work per byte.  A small table
    would otherwise be coalesced by size into one or two tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)
