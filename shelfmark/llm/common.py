"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.stable import ensure_checkpoint_dir

#: Rows and bytes of one Arrow batch: a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir)."""
    ensure_checkpoint_dir(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return os.path.join(top, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table behind what ``written`` returned; for tables that nothing lazy reads any more."""
    path = getattr(df, "_written_to", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def guarded(docs: DataFrame, taken: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run(docs)`` with the columns of ``docs``, whatever their names: those that an operator's own columns
    (``taken``) would clash with are renamed meanwhile."""
    away = {c: f"{c}_kept_{k}" for k, c in enumerate(docs.columns) if c.lower() in {t.lower() for t in taken}}
    out = run(docs.withColumnsRenamed(away))
    return out.select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns])


def fold_of(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 5.  NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5


def share_of(key: Column) -> Column:
    """A hash of ``key`` as a number from 0 to 1, for bounded samples of labelled rows."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
