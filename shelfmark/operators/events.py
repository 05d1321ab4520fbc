"""Job and event analytics: durations, throughput, stage metrics, throttling, tails, redaction."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.text import basename
from shelfmark.operators.ordered import one_row, running_total, with_previous

RENAME_ONLY = "rename-zip"


def mib_per_second(size: Column, milliseconds: Column) -> Column:
    rate = (size.cast("double") / F.lit(1048576.0)) / (milliseconds.cast("double") / F.lit(1000.0))
    return F.when((size <= 0) | (milliseconds <= 0), 0.0).otherwise(rate)


def _ms(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000).cast("bigint")


def with_durations(jobs: DataFrame, now: Column) -> DataFrame:
    """Adds queue_wait_ms, duration_ms and the MiB/s columns; an end never precedes its start and
    rename-only jobs have no rates."""
    end = F.greatest(F.coalesce("finished", now), F.col("started"))
    df = jobs.withColumns({"queue_wait_ms": _ms(F.col("created"), F.col("started")), "duration_ms": _ms(F.col("started"), end)})
    timed = (F.coalesce("operation", F.lit("")) != RENAME_ONLY) & (F.coalesce("duration_ms", F.lit(0)) > 0)
    rate = lambda size: F.when(timed, mib_per_second(size, F.col("duration_ms"))).otherwise(0.0)
    return df.withColumns(
        {
            "read_mib_s": rate(F.col("bytes_read")), "write_mib_s": rate(F.col("bytes_written")),
            "io_mib_s": rate(F.col("bytes_read") + F.col("bytes_written")),
        }
    )


def job_summary(jobs: DataFrame, now: Column) -> DataFrame:
    j = with_durations(jobs, now)
    n = lambda s: F.count_if(F.col("state") == s)
    io = F.col("bytes_read") + F.col("bytes_written")
    measured = (F.col("state") == "succeeded") & (F.col("operation") != RENAME_ONLY) & (F.col("duration_ms") > 0) & (io > 0)
    out = j.agg(
        F.count("*").alias("total"), n("queued").alias("queued"), n("running").alias("running"),
        n("succeeded").alias("succeeded"), n("failed").alias("failed"), n("cancelled").alias("cancelled"),
        F.sum("bytes_read").alias("bytes_read"), F.sum("bytes_written").alias("bytes_written"),
        F.coalesce(F.sum(F.when(F.col("state") == "running", F.col("io_mib_s"))), F.lit(0.0)).alias("active_mib_s"),
        F.count_if(measured).alias("measured_jobs"),
        F.coalesce(F.sum(F.when(measured, io)), F.lit(0)).alias("_b"),
        F.coalesce(F.sum(F.when(measured, F.col("duration_ms"))), F.lit(0)).alias("_ms"),
    )
    return out.withColumn("completed_mib_s", mib_per_second(F.col("_b"), F.col("_ms"))).drop("_b", "_ms")


# --- stages --------------------------------------------------------------------------------
ORDER = ["time", "line"]


def _order():
    return [F.col(c) for c in ORDER]


def stage_changes(events: DataFrame) -> DataFrame:
    """Events whose stage differs from the one before in the same job."""
    named = events.where("coalesce(stage, '') <> ''")
    return with_previous(named, ["job_id"], _order(), ["stage"]).where(
        "prev_stage IS NULL OR prev_stage <> stage"
    ).drop("prev_stage")


def stage_spans(events: DataFrame) -> DataFrame:
    """(job_id, stage, duration_ms, bytes_read, bytes_written): one row per run of a stage, from
    its first event to the first event of the next one, or to the last event of the job."""
    columns = ["stage", "time", "bytes_read", "bytes_written"]
    changes = stage_changes(events).select("job_id", *columns, "line")
    closed = with_previous(changes, ["job_id"], _order(), columns).where("prev_stage IS NOT NULL")
    at = F.struct("time", "line")
    last_change = changes.groupBy("job_id").agg(F.max_by(F.struct(*columns), at).alias("s"))
    last_event = events.groupBy("job_id").agg(F.max_by(F.struct("time", "bytes_read", "bytes_written"), at).alias("e"))
    tail = last_change.join(last_event, "job_id")

    def span(df, start, end_time, end_read, end_written):
        return df.select(
            "job_id", start("stage").alias("stage"), _ms(start("time"), end_time).alias("duration_ms"),
            F.greatest(end_read - start("bytes_read"), F.lit(0)).alias("bytes_read"),
            F.greatest(end_written - start("bytes_written"), F.lit(0)).alias("bytes_written"),
        )

    spans = span(
        closed, lambda c: F.col(f"prev_{c}"), F.col("time"), F.col("bytes_read"), F.col("bytes_written")
    ).unionByName(
        span(tail, lambda c: F.col(f"s.{c}"), F.col("e.time"), F.col("e.bytes_read"), F.col("e.bytes_written"))
    )
    return spans.where("stage <> 'done'")


def stage_metrics(events: DataFrame) -> DataFrame:
    total = stage_spans(events).groupBy("job_id", "stage").agg(
        F.count("*").alias("runs"), F.sum("duration_ms").alias("duration_ms"), F.sum("bytes_read").alias("bytes_read"),
        F.sum("bytes_written").alias("bytes_written"),
    )
    return total.withColumn("io_mib_s", mib_per_second(F.col("bytes_read") + F.col("bytes_written"), F.col("duration_ms")))


def throttled(events: DataFrame, every: int = fv.THROTTLE_BYTES) -> DataFrame:
    """Events worth logging: each change from the last named stage to another named one, then whenever the
    larger byte count has grown by ``every`` since the last kept event (since 0 before the first stage).

    The rule restarts at a stage change, so runs of a stage are independent: they are spread over
    tasks.  Inside a run the next kept event is the first at which the running maximum reaches the last kept
    count plus ``every``, so a task jumps from one kept event to the next."""
    named = with_previous(events.where("stage <> ''"), ["job_id"], _order(), ["stage"])
    change = F.coalesce((F.col("stage") != F.col("prev_stage")), F.lit(True)).cast("int")
    rest = events.where("NOT coalesce(stage <> '', false)").withColumn("_first", F.lit(0))
    flagged = named.withColumn("_first", change).drop("prev_stage").unionByName(rest)
    runs = running_total(flagged, ["job_id"], _order(), F.col("_first"), "_run")
    runs = runs.withColumn("_bytes", F.greatest("bytes_read", "bytes_written"))
    schema = runs.schema

    def walk(batches):
        key, last = None, 0
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            job, run = pdf["job_id"].to_numpy(), pdf["_run"].to_numpy()
            sizes = pdf["_bytes"].to_numpy()
            edges = np.flatnonzero((job[1:] != job[:-1]) | (run[1:] != run[:-1])) + 1 if len(pdf) else []
            for start, stop in zip([0, *edges], [*edges, len(pdf)]):
                if stop == start:
                    continue
                top = np.maximum.accumulate(sizes[start:stop])
                at = 0
                if (job[start], run[start]) != key:
                    key, last = (job[start], run[start]), 0
                    if run[start]:
                        keep[start], last, at = True, sizes[start], 1
                # Places before ``at`` are below the goal or kept, so the search may start anywhere.
                at = max(at, int(np.searchsorted(top, last + every)))
                while at < stop - start:
                    keep[start + at], last = True, sizes[start + at]
                    at = max(at + 1, int(np.searchsorted(top, last + every)))
            yield pdf[keep]

    spread = runs.repartition("job_id", "_run").sortWithinPartitions("job_id", "_run", *ORDER)
    return spread.mapInPandas(walk, schema).drop("_run", "_bytes", "_first")


# --- logs ---------------------------------------------------------------------------------------
def is_job_id(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9_-]{1,128}\z")


def tail(lines: DataFrame, max_lines: int = 500) -> DataFrame:
    """The last ``max_lines`` lines of each job, then those that are JSON objects.  Ranking
    with a fixed limit is cut down on the map side before the shuffle."""
    if max_lines < 1:
        raise ValueError("max_lines must be positive")
    newest = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("line")))
    last = lines.withColumn("_n", newest).where(F.col("_n") <= max_lines).drop("_n")
    parsed = F.try_parse_json("text")
    return last.where(parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT"))


def latest_logs(logs: DataFrame, n: int = 10) -> DataFrame:
    return logs.orderBy(F.desc("updated_at"), "job_id").limit(n)


def log_info(events: DataFrame) -> DataFrame:
    """(job_id, size_bytes, updated_at) per job log."""
    return events.groupBy("job_id").agg(
        F.sum(F.length("props") + 1).alias("size_bytes"), F.max("time").alias("updated_at")
    )


def retention_expired(logs: DataFrame, now: Column, days: int = fv.RETENTION_DAYS) -> DataFrame:
    return logs.where(F.col("updated_at") < now - F.make_dt_interval(F.lit(days)))


def bundled_logs(logs: DataFrame, job_id: str | None = None) -> DataFrame:
    """The logs of a support bundle: that of one job, or the ten newest."""
    return latest_logs(logs) if job_id is None else logs.where(F.col("job_id") == job_id)


def support_bundle(events: DataFrame, logs: DataFrame, job_id: str | None = None) -> DataFrame:
    chosen = bundled_logs(logs, job_id).select("job_id")
    return events.join(F.broadcast(chosen), "job_id", "left_semi")  # ten rows


def bundle_metadata(events: DataFrame, logs: DataFrame, job_id: str | None = None) -> DataFrame:
    """One row about a bundle: its jobs, lines, bytes, errors and span of time, beside what the whole log has."""
    held = bundled_logs(logs, job_id).agg(F.count("*").alias("jobs"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))
    rows = support_bundle(events, logs, job_id).agg(
        F.count("*").alias("lines"), F.count_if(F.col("stage") == "error").alias("errors"), F.min("time").alias("first"), F.max("time").alias("last")
    )
    whole = logs.agg(F.count("*").alias("all_jobs"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("all_bytes"))
    return one_row(held, rows, whole)


def redacted(fields: Column, depth: int = 1) -> Column:
    """map<string,variant>: secrets go, paths keep their last part, other values stay as typed.  Objects inside are treated
    alike down to ``depth`` levels."""

    def one(k, v):
        low = F.lower(k)
        secret = low.contains("password") | low.contains("secret") | low.contains("token")
        is_text = F.schema_of_variant(v) == "STRING"
        short = F.when(is_text, basename(F.try_variant_get(v, "$", "string"))).otherwise("[REDACTED_PATH]")
        kept = v
        if depth > 1:
            inner = F.parse_json(F.to_json(redacted(F.from_json(F.to_json(v), "map<string,variant>"), depth - 1)))
            kept = F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), inner).otherwise(v)
        return (
            F.when(secret, F.lit("[REDACTED]").cast("variant")).when(low.contains("path"), short.cast("variant")).otherwise(kept)
        )

    return F.transform_values(fields, one)


def field_types(events: DataFrame) -> DataFrame:
    """(field, events, type): the keys that log writers use and the type that holds all their values."""
    rows = events.select(F.explode("fields").alias("field", "value"))
    return rows.groupBy("field").agg(F.count("*").alias("events"), F.schema_of_variant_agg("value").alias("type"))
