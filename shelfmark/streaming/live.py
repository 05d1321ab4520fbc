"""Live views over append-only inputs: job state, throttled progress, and file intake."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from shelfmark.functions import fixed_values as fv
from shelfmark.functions import naming as N
from shelfmark.operators.cluster import with_alias
from shelfmark.operators.manifest import publish_decisions
from shelfmark.operators.stable import pinned
from shelfmark.plans.inbox import destination, reused_folders
from shelfmark.sources.versioned import VersionedTable


def job_state(events: DataFrame) -> DataFrame:
    """Current stage, bytes and event count of each job; works on batch and streaming input."""
    at = F.struct("time", "line")
    return events.groupBy("job_id").agg(
        F.max_by("stage", at).alias("stage"), F.max("bytes_read").alias("bytes_read"),
        F.max("bytes_written").alias("bytes_written"), F.count("*").alias("events"),
        F.count_if(F.col("stage") == "error").alias("errors"),
    )


class Throttle(StatefulProcessor):
    """Keeps stage changes and every further ``every`` bytes of a job.  The state of a job is its last stage and the last kept byte
    count; it goes ``ttl_ms`` after its last event.

    The rows of a job come in chunks of Arrow size.  Of each chunk only the columns that the rule reads are held, as arrays, and
    put in order once all chunks are there; a run of one stage is then walked from kept event to kept event."""

    def __init__(self, every: int, ttl_ms: int | None):
        self.every, self.ttl_ms = every, ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "stage string, bytes bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        names: dict[str, int] = {"": 0}
        chunks = []
        for pdf in rows:
            stage = np.fromiter((names.setdefault(x or "", len(names)) for x in pdf["stage"]), np.int32, len(pdf))
            chunks.append((pdf["time"].to_numpy(), pdf["line"].to_numpy(), stage, pdf["bytes_read"].to_numpy(), pdf["bytes_written"].to_numpy()))
        time, line, stage, read, written = (np.concatenate(x) for x in zip(*chunks))
        by = np.lexsort((line, time))
        time, line, stage, read, written = (x[by] for x in (time, line, stage, read, written))
        said, kept = self.last.get() if self.last.exists() else ("", 0)
        keep, said_now, kept = kept_events(stage, np.maximum(read, written), names.setdefault(said, len(names)), int(kept), self.every)
        text = list(names)
        self.last.update((text[said_now], kept))
        at = np.flatnonzero(keep)
        yield pd.DataFrame({
            "job_id": pd.Series([key[0]] * len(at), dtype=object), "time": time[at], "line": line[at],
            "stage": pd.Series([text[k] for k in stage[at]], dtype=object), "bytes_read": read[at], "bytes_written": written[at],
        })

    def close(self) -> None:
        pass


def kept_events(stage: np.ndarray, sizes: np.ndarray, said: int, last: int, every: int) -> tuple[np.ndarray, int, int]:
    """(flags, last named stage, last kept size) of ordered events; stage 0 is none, ``said`` the stage named before."""
    keep = np.zeros(len(stage), bool)
    named = np.flatnonzero(stage)
    changes = named[stage[named] != np.concatenate([[said], stage[named[:-1]]])[: len(named)]]
    keep[changes] = True
    for start, stop in zip([0, *changes], [*changes, len(stage)]):
        top, at = np.maximum.accumulate(sizes[start:stop]), 0
        if start < len(stage) and keep[start]:
            last, at = int(sizes[start]), 1
        at = max(at, int(np.searchsorted(top, last + every)))
        while at < stop - start:
            keep[start + at], last = True, int(sizes[start + at])
            at = max(at + 1, int(np.searchsorted(top, last + every)))
    return keep, int(stage[named[-1]]) if len(named) else said, last


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def throttled_stream(events: DataFrame, every: int = fv.THROTTLE_BYTES, expire: bool = True) -> DataFrame:
    """The events worth keeping, as (job_id, time, line, stage, bytes_read, bytes_written); the state of a job expires after two
    weeks without events.

    Needs the RocksDB state store.  A micro-batch is what one trigger reads: bound it by ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger``.  A bounded replay (``availableNow``) ends only with
    ``spark.sql.streaming.noDataMicroBatches.enabled`` false, as processing time always asks for one more batch."""
    ttl = fv.RETENTION_DAYS * 86_400_000 if expire else None
    schema = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in ("job_id", "time", "line", "stage", "bytes_read", "bytes_written"))
    rows = events.select("job_id", "time", "line", "stage", "bytes_read", "bytes_written")
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Throttle(every, ttl), outputStructType=schema, outputMode="append", timeMode="processingTime"
    )


def intake(arrivals: DataFrame, alias_index: DataFrame, library: DataFrame, output_root: str) -> DataFrame:
    """Plans for new files (a batch, or one micro-batch): parse, saved alias, existing folder,
    destination.  Everything is a join with the catalogue tables; nothing is collected."""
    df = N.with_parsed_name(arrivals, "name").select(
        "name", F.col("parsed.series").alias("series"), F.col("parsed.volume").alias("volume"),
        F.col("parsed.confidence").alias("confidence"),
    )
    df = with_alias(df, alias_index).withColumn("series", F.coalesce("alias_canonical", "series")).drop("alias_canonical")
    folders = reused_folders(df.select("series").distinct(), library, output_root).select("series", "folder")
    return df.join(folders, "series").select(
        "name", F.col("folder").alias("series"), "volume", "confidence",
        destination(output_root, F.col("folder"), F.col("name")).alias("destination"),
    )


def start_intake(arrivals: DataFrame, alias_index: DataFrame, library: DataFrame, output_root: str, table: str, checkpoint: str):
    """Appends the plans of every micro-batch to a table folder, one folder per batch: a batch
    that is run again after a failure replaces its own folder."""

    def plan(batch: DataFrame, batch_id: int) -> None:
        intake(batch, alias_index, library, output_root).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# --- intake into a catalogue -----------------------------------------------------------------------
CATALOGUE_SCHEMA = (
    "path string, series string, name string, volume int, size bigint, modified timestamp, sha256 string, batch bigint"
)


def catalogue(spark: SparkSession, path: str, buckets: int = 16) -> VersionedTable:
    """The table of planned and present outputs, one row for each path."""
    return VersionedTable(spark, path, CATALOGUE_SCHEMA, "path", buckets)


def intake_decisions(arrivals: DataFrame, alias_index: DataFrame, existing: DataFrame, output_root: str) -> DataFrame:
    """One row for each distinct arrival (name, size, modified, sha256; ``arrivals`` counts equal ones): its series, folder,
    path and decision against the rows of the catalogue.

    Of the arrivals for one path the newest (then the largest, then the greatest digest) stands against the catalogue; the others are
    compared with what stays: exact duplicates, or older, so that the path keeps what it has."""
    rows = arrivals.groupBy("name", "size", "modified", "sha256").agg(F.count("*").alias("arrivals"))
    df = N.with_parsed_name(rows, "name").select(
        "name", "size", "modified", "sha256", "arrivals", F.col("parsed.series").alias("series"), F.col("parsed.volume").alias("volume"),
        F.col("parsed.confidence").alias("confidence"),
    )
    df = pinned(with_alias(df, alias_index).withColumn("series", F.coalesce("alias_canonical", "series")).drop("alias_canonical"))
    there = existing.where(F.startswith("path", F.lit(output_root + "/"))).select(
        F.lit(output_root).alias("root"), F.substr("path", F.lit(len(output_root) + 2)).alias("rel")
    )
    folders = reused_folders(df.select("series").distinct(), there, output_root, shared=True).select("series", "folder")
    planned = df.join(folders, "series").withColumn("target", destination(output_root, F.col("folder"), F.col("name"))).drop("series")
    planned = pinned(planned.withColumnRenamed("folder", "series"))
    version = F.struct("modified", "size", "sha256")
    lead = planned.groupBy("target").agg(F.max(version).alias("lead"))
    lead = lead.select("target", "lead.*")
    # What a path holds after this batch: its leading arrival or the row it had.
    verdict = publish_decisions(lead, existing).select("target", F.col("decision").alias("_lead_decision"), F.struct("modified", "size", "sha256").alias("_lead"))
    old = existing.select(F.col("path").alias("target"), F.struct("size", "sha256").alias("_old"))
    after = verdict.join(old, "target", "left").withColumn(
        "_stays", F.when(F.col("_lead_decision") == "use-candidate", F.struct("_lead.size", "_lead.sha256")).otherwise(F.col("_old"))
    )
    is_lead = version.eqNullSafe(F.col("_lead"))
    same = F.struct("size", "sha256").eqNullSafe(F.col("_stays"))
    return planned.join(after.select("target", "_lead", "_lead_decision", "_stays"), "target").withColumn(
        "decision", F.when(is_lead, F.col("_lead_decision")).when(same, "exact-duplicate").otherwise("keep-existing")
    ).select("name", "size", "modified", "sha256", "arrivals", "series", "volume", "confidence", F.col("target").alias("path"), "decision")


def intake_upsert(batch: DataFrame, batch_id: int, alias_index: DataFrame, table: VersionedTable, output_root: str, decisions: str) -> bool:
    """Plans a micro-batch, writes its decisions to their folder of ``decisions`` and merges the outputs to be used into ``table``, so
    that the next batch meets them.  A batch that was merged before is left alone; one that failed in between writes the
    same again, because the catalogue has not changed."""
    done = table.last_commit()
    if done is not None and batch_id <= done:
        return False
    folder = f"{decisions}/batch={batch_id}"
    intake_decisions(batch, alias_index, table.read(), output_root).write.mode("overwrite").parquet(folder)
    used = batch.sparkSession.read.parquet(folder).where("decision = 'use-candidate'").withColumn("batch", F.lit(batch_id).cast("long"))
    return table.merge(used, batch_id)


def start_intake_upsert(arrivals: DataFrame, alias_index: DataFrame, table: VersionedTable, output_root: str, decisions: str, checkpoint: str):
    """``arrivals``: a stream of (name, size, modified, sha256)."""

    def plan(batch: DataFrame, batch_id: int) -> None:
        intake_upsert(batch, batch_id, alias_index, table, output_root, decisions)

    return (
        arrivals.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
