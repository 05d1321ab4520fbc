"""Queries over real files: trees that Spark writes from the documents, then lists, hashes and reads."""

import os
from functools import partial

import pyarrow as pa
from pyspark.sql import functions as F

from checks import views as V
from checks.memo import own_work
from checks.q_events import scratch
from shelfmark.sources import listing as L

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(fn):
        QUERIES[name] = own_work(fn)
        if sql:
            SQL[name] = sql
        return fn

    return put


# --- a tree of files --------------------------------------------------------------------------------
# One file for each document: three roots, folders up to five deep, quarantine folders at the top and further down.
_TREE = f"""
SELECT 'r' || CAST(doc_id % 3 AS VARCHAR(3)) AS root,
  CASE WHEN doc_id % 7 = 0 THEN '{V.QUARANTINE}/' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'even/' ELSE 'odd/' END
    || CASE WHEN doc_id % 11 = 0 THEN '{V.QUARANTINE}/' ELSE '' END || repeat('d/', CAST(doc_id % 5 AS INT)) || CAST(doc_id AS VARCHAR(20)) || '.txt' AS rel,
  coalesce(text, '') AS text, doc_id
FROM {{documents}}"""


def put_files(base, batches):
    """Writes each row's bytes to its path, with ``mtime`` as its time where given (a mounted folder); a task that runs again writes the same."""
    from pyarrow import fs

    for b in batches:
        times = b["mtime"].to_pylist() if "mtime" in b.schema.names else [None] * len(b)
        for path, data, mtime in zip(b["path"].to_pylist(), b["data"].to_pylist(), times):
            store, at = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)
            store.create_dir(os.path.dirname(f"{at}/{path}"), recursive=True)
            with store.open_output_stream(f"{at}/{path}") as out:
                out.write(data)
            if mtime:
                os.utime(f"{at}/{path}", (mtime, mtime))
        yield pa.RecordBatch.from_arrays([b["path"]], ["path"])


def local(folder):
    """A ``file:`` address as a path; others stay."""
    return "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") or "://" not in folder else folder


def tree(spark, sf, base):
    files = spark.sql(_TREE, documents=V.table(spark, sf, "documents"))
    rows = files.select(F.concat_ws("/", "root", "rel").alias("path"), F.col("text").cast("binary").alias("data"))
    rows.mapInArrow(partial(put_files, base), "path string").count()


_FILES = f"SELECT *, octet_length(encode(text)) AS size, CASE WHEN root = 'r1' AND starts_with(rel, 'even/') THEN 'r1/even' ELSE root END AS own FROM ({_TREE.format(documents='documents')})"
_LISTED = "SELECT '{label}' AS walk, own AS root, CASE WHEN own = 'r1/even' THEN substr(rel, 6) ELSE rel END AS rel, CAST(size AS BIGINT) AS size, false AS failed FROM f WHERE {where}"
_HIDDEN = f"contains('/' || rel, '/{V.QUARANTINE}/')"


@query(
    "walk_roots",
    f"WITH f AS ({_FILES}) {_LISTED.format(label='all', where='true')} UNION ALL {_LISTED.format(label='library', where=f'NOT {_HIDDEN}')} "
    "UNION ALL SELECT unnest(['all', 'library']), 'gone', '', NULL, true",
)
def walk_roots(spark, sf):
    """Roots with spaces, twice, inside one another and absent, with and without the quarantine."""
    base = local(scratch(spark))
    tree(spark, sf, base)
    given = [f"{base}/r1/even", f" {base}/r0/ ", f"{base}/./r1", f"{base}/r0", f"{base}/r2", f"{base}/gone"]
    roots, _ = L.normalise_roots(given)
    short = lambda c: F.substr(c, F.lit(len(base) + 2))
    out = None
    for label, quarantine in (("all", True), ("library", False)):
        seen = L.walk(spark, roots, include_quarantine=quarantine)
        files = L.listed(seen).select(F.lit(label).alias("walk"), short("root").alias("root"), "rel", "size", F.lit(False).alias("failed"))
        bad = L.unreadable(seen).select(
            F.lit(label).alias("walk"), short("root").alias("root"), F.lit("").alias("rel"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("failed")
        )
        rows = files.unionByName(bad)
        out = rows if out is None else out.unionByName(rows)
    return out


# --- copies by bytes --------------------------------------------------------------------------------
_BLOCK = 512
_STAGES = (
    f"WITH f AS MATERIALIZED (SELECT root || '/' || rel AS path, octet_length(encode(text)) AS size, left(hex(encode(text)), {2 * _BLOCK}) AS head, sha256(text) AS whole FROM ({_TREE.format(documents='documents')})), "
    "s AS (SELECT *, count(*) OVER (PARTITION BY size) > 1 AS sized, count(*) OVER (PARTITION BY size, head) > 1 AS alike, count(*) OVER (PARTITION BY whole) AS n, min(path) OVER (PARTITION BY whole) AS first FROM f) "
)


@query(
    "copies_by_bytes",
    _STAGES + f"SELECT path, CAST(size AS BIGINT) AS size, CAST(CASE WHEN NOT sized THEN 0 WHEN size <= {_BLOCK} THEN size ELSE {_BLOCK} + CASE WHEN alike THEN size ELSE 0 END END AS BIGINT) AS bytes_read, CASE WHEN n > 1 THEN first END AS copy_of FROM s",
)
def copies_by_bytes(spark, sf):
    from shelfmark.operators.copies import staged_hashes

    base = local(scratch(spark))
    tree(spark, sf, base)
    files = L.listed(L.walk(spark, [base], include_quarantine=True)).select("path", "size")
    hashed = staged_hashes(files, block=_BLOCK)
    first = hashed.where("sha256 IS NOT NULL").groupBy("size", "sha256").agg(F.min("path").alias("copy_of"), F.count("*").alias("n")).where("n > 1").drop("n")
    short = lambda c: F.substr(c, F.lit(len(base) + 2)).alias(c)
    return hashed.join(first, ["size", "sha256"], "left").select(short("path"), "size", "bytes_read", short("copy_of"))


# --- log files --------------------------------------------------------------------------------------
_LOGS = "SELECT 'logs/' || lang || '/job-' || CAST(doc_id AS VARCHAR(20)) || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.jsonl' END AS path, text, doc_id FROM (SELECT coalesce(lang, 'none') AS lang, coalesce(text, '') AS text, doc_id FROM {documents}) d"
_AGE = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * doc_id"


@query(
    "log_file_retention",
    f"WITH l AS (SELECT 'job-' || doc_id AS job_id, octet_length(encode(text))::BIGINT AS size_bytes, {_AGE} AS seen FROM ({_LOGS.format(documents='documents')}) WHERE doc_id % 9 <> 0) "
    "SELECT 'expired' AS list, job_id, size_bytes FROM l WHERE seen < TIMESTAMP '2024-02-01 12:30:00' - INTERVAL 14 DAY UNION ALL SELECT 'latest', job_id, size_bytes FROM (SELECT * FROM l ORDER BY seen DESC, job_id LIMIT 10)",
)
def log_file_retention(spark, sf):
    """What to delete and what to bundle, by the times and sizes that the file system has."""
    from shelfmark.operators import events as E
    from shelfmark.sources.logs import log_files

    base = local(scratch(spark))
    rows = spark.sql(_LOGS, documents=V.table(spark, sf, "documents")).select(
        "path", F.col("text").cast("binary").alias("data"), (F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + 3600 * F.col("doc_id")).alias("mtime")
    )
    rows.mapInArrow(partial(put_files, base), "path string").count()
    logs = log_files(spark, f"{base}/logs")
    old = E.retention_expired(logs, F.expr("TIMESTAMP '2024-02-01 12:30:00'"))
    part = lambda df, name: df.select(F.lit(name).alias("list"), "job_id", "size_bytes")
    return part(old, "expired").unionByName(part(E.latest_logs(logs), "latest"))


# --- fields of log lines ----------------------------------------------------------------------------
_FIELDS = """'{"source_path":"/in/' || job_id || '/' || stage || '.zip","numeric_path":' || CAST(line AS VARCHAR(20)) || ',"api_token":"' || job_id || '","nested":{"out_path":"/a/' || stage || '","n":[1,2],"deep":{"Password":7,"x":' || CAST(line AS VARCHAR(20)) || '}},"Stage":"' || stage || '"}'"""
_OPEN = """'{"source_path":"' || stage || '.zip","numeric_path":"[REDACTED_PATH]","api_token":"[REDACTED]","nested":{"deep":{"Password":"[REDACTED]","x":' || line || '},"n":[1,2],"out_path":"' || stage || '"},"Stage":"' || stage || '"}'"""


def field_log(spark, sf):
    from shelfmark.sources.logs import read_events

    folder = scratch(spark)
    lines = V.log(spark, sf).selectExpr("job_id", "stage", "line", f"{_FIELDS} AS fields")
    lines.select(F.concat(F.lit('{"job_id":"'), "job_id", F.lit('","bytes_read":'), F.col("line").cast("string"), F.lit(',"fields":'), "fields", F.lit("}")).alias("value")).write.text(folder)
    return read_events(spark, folder)


@query("redact_log", f"SELECT line, {_OPEN} AS fields FROM ({V.LOG_SQL})")
def redact_log(spark, sf):
    """Lines as they lie in the log, with objects inside objects; no key is known beforehand."""
    from shelfmark.operators import events as E

    return field_log(spark, sf).select(F.col("bytes_read").alias("line"), F.to_json(E.redacted(F.col("fields"), depth=3)).alias("fields"))


@query(
    "field_types",
    f"SELECT field, n AS events, type FROM (SELECT count(*) AS n FROM ({V.LOG_SQL})), (VALUES ('source_path', 'STRING'), ('numeric_path', 'BIGINT'), ('api_token', 'STRING'), "
    "('nested', 'OBJECT<deep: OBJECT<Password: BIGINT, x: BIGINT>, n: ARRAY<BIGINT>, out_path: STRING>'), ('Stage', 'STRING')) AS t(field, type)",
)
def field_types(spark, sf):
    from shelfmark.operators import events as E

    return E.field_types(field_log(spark, sf))
