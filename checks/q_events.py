"""Queries of jobs, events, logs and streams."""

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from checks import sql_naming as S
from checks import views as V
from checks.memo import own_work
from shelfmark.operators import events as E
from shelfmark.operators.stable import ensure_checkpoint_dir
from shelfmark.sources import logs as G
from shelfmark.streaming import live

QUERIES, SQL = {}, {}
NOW = "TIMESTAMP '2002-01-01 00:00:00'"


def query(name, sql=None):
    def put(fn):
        QUERIES[name] = own_work(fn)
        if sql:
            SQL[name] = sql
        return fn

    return put


def scratch(spark):
    """A fresh folder next to the checkpoints: shared storage on a cluster."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get() + "/scratch-" + uuid.uuid4().hex


def now(spark):
    return F.expr(NOW)


# --- jobs -----------------------------------------------------------------------------------
_END = f"greatest(coalesce(finished, {NOW}), started)"
_DUR = f"CAST(floor((epoch_us({_END}) - epoch_us(started)) / 1000) AS BIGINT)"
_J = f"SELECT *, CAST(floor((epoch_us(started) - epoch_us(created)) / 1000) AS BIGINT) AS queue_wait_ms, {_DUR} AS duration_ms FROM ({V.JOBS_SQL})"


def _rate(size, ms="duration_ms"):
    return f"(CAST({size} AS DOUBLE) / CAST(1048576.0 AS DOUBLE)) / (CAST({ms} AS DOUBLE) / CAST(1000.0 AS DOUBLE))"


def _job_rate(size):
    return f"CASE WHEN operation <> 'rename-zip' AND duration_ms > 0 AND {size} > 0 THEN {_rate(size)} ELSE CAST(0 AS DOUBLE) END"


_JR = f"SELECT *, {_job_rate('bytes_read')} AS read_mib_s, {_job_rate('bytes_written')} AS write_mib_s, {_job_rate('(bytes_read + bytes_written)')} AS io_mib_s FROM ({_J})"


@query("job_durations", f"SELECT id, queue_wait_ms, duration_ms, round(io_mib_s, 6) AS io_mib_s FROM ({_JR})")
def job_durations(spark, sf):
    j = E.with_durations(V.jobs(spark, sf), now(spark))
    return j.select("id", "queue_wait_ms", "duration_ms", F.round("io_mib_s", 6).alias("io_mib_s"))


_M = "state = 'succeeded' AND operation <> 'rename-zip' AND duration_ms > 0 AND bytes_read + bytes_written > 0"


@query(
    "job_summary",
    "SELECT count(*) AS total, count_if(state = 'queued') AS queued, count_if(state = 'running') AS running, count_if(state = 'succeeded') AS succeeded, count_if(state = 'failed') AS failed, "
    "count_if(state = 'cancelled') AS cancelled, sum(bytes_read)::BIGINT AS bytes_read, sum(bytes_written)::BIGINT AS bytes_written, round(coalesce(sum(CASE WHEN state = 'running' THEN io_mib_s END), 0), 4) AS active_mib_s, "
    f"count_if({_M}) AS measured_jobs, round({_rate(f'sum(CASE WHEN {_M} THEN bytes_read + bytes_written END)', f'sum(CASE WHEN {_M} THEN duration_ms END)')}, 6) AS completed_mib_s FROM ({_JR})",
)
def job_summary(spark, sf):
    s = E.job_summary(V.jobs(spark, sf), now(spark))
    return s.withColumns({"active_mib_s": F.round("active_mib_s", 4), "completed_mib_s": F.round("completed_mib_s", 6)})


@query("plan_order", f"SELECT id, created, row_number() OVER (ORDER BY created DESC, id) AS position FROM ({V.JOBS_SQL})")
def plan_order(spark, sf):
    from shelfmark.operators.ordered import row_numbers

    return row_numbers(V.jobs(spark, sf).select("id", "created"), [], [F.desc("created"), F.col("id")], "position")


# --- stages ------------------------------------------------------------------------------------
_CH = f"SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY time, line) AS ps FROM ({V.LOG_SQL})"
_SP = (
    f"WITH l AS ({V.LOG_SQL}), c AS (SELECT * FROM ({_CH}) WHERE ps IS NULL OR ps <> stage), "
    "e AS (SELECT job_id, max(time) AS et, arg_max(bytes_read, (time, line)) AS er, arg_max(bytes_written, (time, line)) AS ew FROM l GROUP BY 1), "
    "n AS (SELECT job_id, stage, time, bytes_read, bytes_written, lead(time) OVER w AS nt, lead(bytes_read) OVER w AS nr, lead(bytes_written) OVER w AS nw FROM c WINDOW w AS (PARTITION BY job_id ORDER BY time, line)), "
    "s AS (SELECT job_id, stage, CAST(floor((epoch_us(coalesce(nt, et)) - epoch_us(time)) / 1000) AS BIGINT) AS duration_ms, greatest(coalesce(nr, er) - bytes_read, 0) AS bytes_read, "
    "greatest(coalesce(nw, ew) - bytes_written, 0) AS bytes_written FROM n JOIN e USING (job_id)) "
)


@query(
    "stage_metrics",
    _SP + "SELECT job_id, stage, count(*) AS runs, sum(duration_ms)::BIGINT AS duration_ms, sum(bytes_read)::BIGINT AS bytes_read, sum(bytes_written)::BIGINT AS bytes_written, "
    f"round(CASE WHEN sum(bytes_read + bytes_written) > 0 AND sum(duration_ms) > 0 THEN {_rate('sum(bytes_read + bytes_written)', 'sum(duration_ms)')} ELSE 0 END, 6) AS io_mib_s FROM s GROUP BY 1, 2",
)
def stage_metrics(spark, sf):
    return E.stage_metrics(V.log(spark, sf)).withColumn("io_mib_s", F.round("io_mib_s", 6))


EVERY = 8 << 20
# Every seventh event of a job has no stage of its own.
_GAPS = "SELECT line, time, job_id, CASE WHEN line % 7 = 0 THEN '' ELSE stage END AS stage, bytes_read, bytes_written, props FROM {src}"
_THR = (
    f"WITH RECURSIVE l AS MATERIALIZED (SELECT line, job_id, stage, greatest(bytes_read, bytes_written) AS b, row_number() OVER (PARTITION BY job_id ORDER BY time, line) AS i FROM ({_GAPS.format(src=f'({V.LOG_SQL})')})), "
    "w(job_id, i, line, kept, last, named) AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST(0 AS BIGINT), '' FROM l UNION ALL "
    f"SELECT l.job_id, l.i, l.line, (l.stage <> '' AND l.stage <> w.named) OR l.b - w.last >= {EVERY}, CASE WHEN (l.stage <> '' AND l.stage <> w.named) OR l.b - w.last >= {EVERY} THEN l.b ELSE w.last END, "
    "CASE WHEN l.stage <> '' THEN l.stage ELSE w.named END FROM w JOIN l ON l.job_id = w.job_id AND l.i = w.i + 1) "
    "SELECT job_id, line FROM w WHERE kept"
)


@query("throttled_progress", _THR)
def throttled_progress(spark, sf):
    return E.throttled(spark.sql(_GAPS, src=V.log(spark, sf)), EVERY).select("job_id", "line")


# --- logs -----------------------------------------------------------------------------------------
_IDS = "CASE line % 4 WHEN 0 THEN job_id WHEN 1 THEN '../' || job_id WHEN 2 THEN '' ELSE repeat(job_id, 30) END"


@query("valid_job_ids", f"SELECT line, id FROM (SELECT line, {_IDS} AS id FROM ({V.LOG_SQL})) WHERE regexp_full_match(id, '[A-Za-z0-9_-]{{1,128}}')")
def valid_job_ids(spark, sf):
    return V.log(spark, sf).selectExpr("line", f"{_IDS} AS id").where(E.is_job_id(F.col("id")))


_TEXT = "CASE WHEN line % 10 = 3 THEN '{broken' WHEN line % 10 = 4 THEN '17' ELSE props END"


@query("event_tail", f"SELECT job_id, line, text FROM (SELECT job_id, line, {_TEXT} AS text, row_number() OVER (PARTITION BY job_id ORDER BY line DESC) AS n FROM ({V.LOG_SQL})) WHERE n <= 20 AND starts_with(text, '{{\"')")
def event_tail(spark, sf):
    return E.tail(V.log(spark, sf).selectExpr("job_id", "line", f"{_TEXT} AS text"), 20)


_INFO = f"SELECT job_id, sum(length(props) + 1)::BIGINT AS size_bytes, max(time) AS updated_at FROM ({V.LOG_SQL}) GROUP BY 1"


@query("latest_logs", f"SELECT * FROM ({_INFO}) ORDER BY updated_at DESC, job_id LIMIT 10")
def latest_logs(spark, sf):
    return E.latest_logs(E.log_info(V.log(spark, sf)))


@query("retention_expired", f"SELECT * FROM ({_INFO}) WHERE updated_at < TIMESTAMP '2024-02-13 12:00:00' - INTERVAL 14 DAY")
def retention_expired(spark, sf):
    return E.retention_expired(E.log_info(V.log(spark, sf)), F.expr("TIMESTAMP_NTZ '2024-02-13 12:00:00'"))


@query("support_bundle_rows", f"SELECT job_id, line, stage FROM ({V.LOG_SQL}) WHERE job_id IN (SELECT job_id FROM ({_INFO}) ORDER BY updated_at DESC, job_id LIMIT 10)")
def support_bundle_rows(spark, sf):
    log = V.log(spark, sf)
    return E.support_bundle(log, E.log_info(log)).select("job_id", "line", "stage")


_BUNDLE = "(SELECT job_id FROM ({info}) ORDER BY updated_at DESC, job_id LIMIT 10)".format(info=_INFO)


def _bundle_sql(label, which):
    return (
        f"SELECT '{label}' AS bundle, (SELECT count(*) FROM ({_INFO}) WHERE job_id IN {which}) AS jobs, (SELECT sum(size_bytes)::BIGINT FROM ({_INFO}) WHERE job_id IN {which}) AS size_bytes, "
        f"count(*) AS lines, count_if(stage = 'error') AS errors, min(time) AS first, max(time) AS last, (SELECT count(*) FROM ({_INFO})) AS all_jobs, (SELECT sum(size_bytes)::BIGINT FROM ({_INFO})) AS all_bytes "
        f"FROM ({V.LOG_SQL}) WHERE job_id IN {which}"
    )


@query("support_bundle_meta", _bundle_sql("newest", _BUNDLE) + " UNION ALL " + _bundle_sql("one", "('job-7')"))
def support_bundle_meta(spark, sf):
    log = V.log(spark, sf)
    logs = E.log_info(log)
    newest = E.bundle_metadata(log, logs).withColumn("bundle", F.lit("newest"))
    return newest.unionByName(E.bundle_metadata(log, logs, "job-7").withColumn("bundle", F.lit("one")))


_FIELDS = "map('source_path', '/in/' || job_id || '/' || stage || '.zip', 'api_token', job_id, 'stage', stage)"


@query(
    "redact_fields",
    f"SELECT line, stage || '.zip' AS source_path, '[REDACTED_PATH]' AS numeric_path, '[REDACTED]' AS api_token, stage AS stage FROM ({V.LOG_SQL})",
)
def redact_fields(spark, sf):
    text = F.to_json(
        F.struct(
            F.concat(F.lit("/in/"), "job_id", F.lit("/"), "stage", F.lit(".zip")).alias("source_path"),
            F.col("line").alias("numeric_path"), F.col("job_id").alias("api_token"), F.col("stage").alias("stage"),
        )
    )
    df = V.log(spark, sf).select("line", F.from_json(text, "map<string,variant>").alias("f"))
    out = df.select("line", E.redacted(F.col("f")).alias("r"))
    keys = ("source_path", "numeric_path", "api_token", "stage")
    return out.select("line", *[F.try_variant_get(F.col("r")[k], "$", "string").alias(k) for k in keys])


@query("event_log_write", f"SELECT job_id, count(*) AS lines, sum(bytes_read)::BIGINT AS bytes_read FROM ({V.LOG_SQL}) GROUP BY 1")
def event_log_write(spark, sf):
    folder = scratch(spark)
    G.write_events(V.log(spark, sf).select("job_id", "time", "stage", "bytes_read", "bytes_written"), folder)
    return G.read_events(spark, folder).groupBy("job_id").agg(F.count("*").alias("lines"), F.sum("bytes_read").alias("bytes_read"))


@query("event_log_read", f"SELECT job_id, stage, count(*) AS events, sum(bytes_read)::BIGINT AS bytes_read FROM ({V.LOG_SQL}) WHERE line % 10 <> 3 GROUP BY 1, 2")
def event_log_read(spark, sf):
    folder = scratch(spark)
    text = F.when(F.col("line") % 10 == 3, F.lit("{broken")).otherwise(F.to_json(F.struct("job_id", "stage", "bytes_read")))
    V.log(spark, sf).select(text.alias("value")).write.text(folder)
    return G.read_events(spark, folder).groupBy("job_id", "stage").agg(F.count("*").alias("events"), F.sum("bytes_read").alias("bytes_read"))


# --- streams --------------------------------------------------------------------------------------
def table_stream(spark, sf, name):
    schema = V.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def finished(stream_query):
    stream_query.awaitTermination()
    if stream_query.exception():
        raise RuntimeError(str(stream_query.exception()))


def log_stream(spark, sf):
    return spark.sql(V.LOG_BODY, events=table_stream(spark, sf, "events"))


# Every tenth line is broken.
_GOOD = f"SELECT * FROM ({V.LOG_SQL}) WHERE line % 10 <> 3"


@query(
    "stream_job_state",
    f"SELECT job_id, arg_max(stage, (time, line)) AS stage, max(bytes_read) AS bytes_read, max(bytes_written) AS bytes_written, count(*) AS events, count_if(stage = 'error') AS errors FROM ({_GOOD}) GROUP BY 1 "
    f"UNION ALL SELECT '', NULL, NULL, NULL, count(*), 0 FROM ({V.LOG_SQL}) WHERE line % 10 = 3",
)
def stream_job_state(spark, sf):
    """A JSONL log that is written in two rounds: broken lines go to a folder of their own, and the second round appends the last
    lines of the first once more."""
    folder = scratch(spark)
    fields = F.to_json(F.struct("job_id", "line", "time", "stage", "bytes_read", "bytes_written"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    text = F.when(F.col("line") % 10 == 3, F.concat(F.lit('{"job_id": '), "job_id")).otherwise(fields)
    log = V.log(spark, sf)
    early, late = log.agg(F.percentile_approx("time", F.array(F.lit(0.4), F.lit(0.5)))).first()[0]
    again = (F.col("time") >= F.lit(early)) & (F.col("time") < F.lit(late)) & (F.col("line") % 10 != 3)
    schema = "job_id string, line bigint, time timestamp, stage string, bytes_read bigint, bytes_written bigint"

    def put(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/state")

    for part in (log.where(F.col("time") < F.lit(late)), log.where((F.col("time") >= F.lit(late)) | again)):
        part.select(text.alias("value")).write.mode("append").text(f"{folder}/log")
        events = G.stream_events(spark, f"{folder}/log", schema)
        finished(G.start_unreadable(events, f"{folder}/unreadable", f"{folder}/cp-unreadable"))
        finished(
            live.job_state(G.readable(events, "10 days")).writeStream.outputMode("complete").foreachBatch(put)
            .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        )
    bad = spark.read.text(f"{folder}/unreadable").agg(F.count("*").alias("events"))
    return spark.read.parquet(f"{folder}/state").unionByName(bad.select(
        F.lit("").alias("job_id"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("bigint").alias("bytes_read"),
        F.lit(None).cast("bigint").alias("bytes_written"), "events", F.lit(0).cast("bigint").alias("errors"),
    ))


@contextmanager
def settings(spark, **values):
    """Session settings for as long as a stream needs them."""
    names = {k: f"spark.sql.streaming.{k.replace('_', '.')}" for k in values}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    try:
        for k, n in names.items():
            spark.conf.set(n, values[k])
        yield
    finally:
        for k, n in names.items():
            spark.conf.unset(n) if before[k] is None else spark.conf.set(n, before[k])


@query("stream_throttle", _THR)
def stream_throttle(spark, sf):
    """The log comes in an earlier and a later half; between them the stream stops and starts again from its checkpoint."""
    folder = scratch(spark)
    log = spark.sql(_GAPS, src=V.log(spark, sf)).drop("props")
    cut = log.agg(F.percentile_approx("time", 0.5)).first()[0]
    for part in (F.col("time") < F.lit(cut), F.col("time") >= F.lit(cut)):
        log.where(part).write.mode("append").parquet(f"{folder}/log")
        arriving = spark.readStream.schema(log.schema).parquet(f"{folder}/log")
        with settings(spark, stateStore_providerClass=live.ROCKSDB, noDataMicroBatches_enabled="false"):
            finished(
                live.throttled_stream(arriving, EVERY).writeStream.outputMode("append").format("parquet")
                .option("path", f"{folder}/kept").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
            )
    return spark.read.parquet(f"{folder}/kept").select("job_id", "line")


_ARRIVALS = "SELECT '[' || p_brand || '] ' || p_name || ' story v' || CAST(p_size AS VARCHAR(9)) || '.zip' AS name FROM {part}"


@query(
    "stream_intake",
    f"WITH f AS (SELECT DISTINCT split_part(rel, '/', 1) AS folder FROM ({V.LIBRARY_SQL}) WHERE root = '/lib0' AND contains(rel, '/') AND NOT starts_with(rel, '.')), "
    f"g AS (SELECT {S.canonical('folder')} AS k, min(folder) AS folder FROM f GROUP BY 1), "
    f"a AS ({S.parsed(_ARRIVALS.format(part='part'), 'name')}) "
    f"SELECT name, coalesce(folder, p_series) AS series, p_volume AS volume, p_confidence AS confidence, '/lib0/' || coalesce(folder, p_series) || '/' || name AS destination FROM a LEFT JOIN g ON g.k = {S.canonical('p_series')}",
)
def stream_intake(spark, sf):
    from checks.q_reconcile import lib
    from shelfmark.operators.cluster import alias_index
    from shelfmark.operators.stable import pinned

    folder = scratch(spark)
    arrivals = spark.sql(_ARRIVALS, part=table_stream(spark, sf, "part"))
    index = pinned(alias_index(spark.createDataFrame([], "alias string, canonical string")))
    finished(live.start_intake(arrivals, index, lib(spark, sf), "/lib0", f"{folder}/plans", f"{folder}/cp"))
    return spark.read.parquet(f"{folder}/plans").drop("batch")
