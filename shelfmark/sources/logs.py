"""The JSONL event log as a source and a sink, batch and streaming."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "time timestamp, level string, component string, job_id string, stage string, message string, error string, "
    "duration_ms bigint, bytes_read bigint, bytes_written bigint, fields map<string,variant>"
)


BUCKETS = 8


def bucket(job_id: Column | str) -> Column:
    """The bucket of a job's events: a filter on it prunes a job's log to one folder a day."""
    return F.pmod(F.xxhash64(job_id), F.lit(BUCKETS)).cast("int")


def write_events(events: DataFrame, folder: str) -> None:
    """Appends events, in folders by day and bucket of the job; a job that has most of the events is
    written by as many tasks as hold it."""
    placed = events.withColumns({"day": F.to_date("time"), "bucket": bucket("job_id")})
    placed.write.mode("append").partitionBy("day", "bucket").json(folder)


def read_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """All events; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, path, size_bytes, updated_at) of the ``.jsonl`` files below a folder, by their metadata: no line is read."""
    from shelfmark.sources.listing import listed, walk

    files = listed(walk(spark, [folder])).where(F.col("name").endswith(".jsonl"))
    return files.select(
        F.regexp_replace("name", r"\.jsonl\z", "").alias("job_id"), "path", F.col("size").alias("size_bytes"), F.col("modified").alias("updated_at")
    )


UNREADABLE = "_unreadable"


def stream_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """The log as it grows.  A line that does not parse has its text in ``_unreadable`` and NULL elsewhere."""
    return (
        spark.readStream.schema(f"{schema}, {UNREADABLE} string").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", UNREADABLE).json(folder)
    )


def readable(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The events of a stream, each once: a line that a writer appends again (same job and line number) within ``late`` is
    dropped, and so is an event that comes later than that."""
    return (
        events.where(F.col(UNREADABLE).isNull()).drop(UNREADABLE).withWatermark("time", late)
        .dropDuplicatesWithinWatermark(["job_id", "line"])
    )


def start_unreadable(events: DataFrame, folder: str, checkpoint: str):
    """Writes the text of the lines that did not parse to a folder of their own, and stops when all that is there is read."""
    # The JSON source does not read its corrupt-record column alone.
    bad = events.where(F.col(UNREADABLE).isNotNull()).select(F.concat(UNREADABLE, F.coalesce("job_id", F.lit(""))).alias("value"))
    return (
        bad.writeStream.outputMode("append").format("text").option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
