"""Input views over the given tables, once for Spark and once as SQL text.

* ``library``  - an archive listing (path, size, time, hash) from lineitem and part
* ``titles``   - every sentence of every document as a series name, author = source
* ``members``  - archive member lists from page URLs
* ``job_rows`` - jobs from orders
* ``log``      - job events from events
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUARANTINE = ".quarantine"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NAME_CASES = {
    "title": [
        ("l_orderkey % 8 = 0", "p_name || ' story'"),
        ("l_orderkey % 8 = 1", "upper(p_name || ' story')"),
        ("l_orderkey % 8 = 2", "replace(p_name || ' story', ' ', '_')"),
        ("l_orderkey % 8 = 3", "p_name || ' story fix'"),
        ("l_orderkey % 8 = 4", "p_name || ' storys'"),
        ("l_orderkey % 8 = 5", "p_name || ' story the second arc'"),
        ("l_orderkey % 8 = 6", "p_name || ' story spin-off'"),
        ("l_orderkey % 8 = 7", "'the ' || p_name || ' story'"),
    ],
    "tag": [
        ("l_partkey % 5 = 0", "'[一般コミック] [' || p_brand || '] '"),
        ("l_partkey % 5 = 1", "'(' || p_brand || ') '"),
        ("l_partkey % 5 = 2", "'【' || p_brand || '】'"),
        ("l_partkey % 5 = 3", "''"),
        ("l_partkey % 5 = 4", "'[' || p_brand || '×' || p_type || '] '"),
    ],
    "vol": [
        ("l_linenumber = 1", "' v' || lpad(CAST(p_size AS VARCHAR(9)), 2, '0')"),
        ("l_linenumber = 2", "' vol.' || CAST(p_size AS VARCHAR(9))"),
        ("l_linenumber = 3", "' 第' || CAST(p_size AS VARCHAR(9)) || '巻'"),
        ("l_linenumber = 4", "' ' || CAST(p_size AS VARCHAR(9))"),
        ("l_linenumber = 5", "'_' || CAST(p_size AS VARCHAR(9))"),
        ("l_linenumber = 6", "' ' || CAST(p_size AS VARCHAR(9)) || '-' || CAST(p_size + 2 AS VARCHAR(9))"),
        ("l_linenumber > 6", "''"),
    ],
    "edition": [
        ("l_partkey % 7 = 0", "' (フルカラー)'"),
        ("l_partkey % 7 = 1", "' [DL版]'"),
        ("l_partkey % 7 = 2", "' モノクロ版'"),
        ("l_partkey % 7 > 2", "''"),
    ],
    "stars": [("l_suppkey % 11 = 0", "'★★ '"), ("l_suppkey % 11 > 0", "''")],
    "ext": [
        ("l_suppkey % 13 = 0", "'.rar'"),
        ("l_suppkey % 13 = 1 AND l_linenumber = 7", "'.part1.rar'"),
        ("l_suppkey % 13 = 2 AND l_linenumber = 7", "'.part2.rar'"),
        ("l_suppkey % 13 = 3", "'.cbz'"),
        ("l_suppkey % 13 = 4", "'.ZIP'"),
        ("l_suppkey % 13 > 0", "'.zip'"),
    ],
    "folder": [
        ("l_orderkey % 6 = 0", "p_name || ' story/'"),
        ("l_orderkey % 6 = 1", "'batch ' || CAST(l_orderkey AS VARCHAR(20)) || '/'"),
        ("l_orderkey % 6 = 2", f"'{QUARANTINE}/' || p_name || ' story/'"),
        ("l_orderkey % 6 = 3", "upper(p_name || ' story') || '/'"),
        ("l_orderkey % 6 = 4", "''"),
        ("l_orderkey % 6 = 5", "p_name || ' story [単行本]/'"),
    ],
}


def _case(branches) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + " END"


_ROOT = "'/lib' || CAST(l_suppkey % 3 AS VARCHAR(3))"
# Stars sit in front of the title proper, after the tag.
_NAME = " || ".join(f"({_case(_NAME_CASES[k])})" for k in ("tag", "stars", "title", "vol", "edition", "ext"))
_REL = f"({_case(_NAME_CASES['folder'])}) || {_NAME}"
_CONTENT = "p_name || '|' || CAST(p_size AS VARCHAR(9)) || '|' || CAST(l_partkey % 2 AS VARCHAR(3))"
LIBRARY_BODY = f"""
SELECT root, rel, root || '/' || rel AS path,
       max(bytes) AS size, max(l_shipdate) AS modified, max(content) AS content
FROM (SELECT {_ROOT} AS root, {_REL} AS rel, l_shipdate, {_CONTENT} AS content,
             CAST(p_size * 1000 + length(p_name) AS BIGINT) AS bytes
      FROM lineitem JOIN part ON l_partkey = p_partkey) listed
GROUP BY root, rel"""

LIBRARY_SQL = f"""
SELECT path, root, rel, regexp_extract(rel, '[^/]*$') AS name, size, modified,
       sha256(content) AS sha256, substr(root, 5) || chr(1) || replace(rel, '/', chr(1)) AS ord
FROM ({LIBRARY_BODY})"""


def _over_items(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(
        text.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}"),
        lineitem=table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"
        ),
        part=table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
    )


def library_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, rel, name) of the listing, with repeats: for what looks at distinct names only."""
    rows = _over_items(spark, sf_dir, f"SELECT {_ROOT} AS root, {_REL} AS rel FROM lineitem JOIN part ON l_partkey = p_partkey")
    return rows.withColumn("name", F.substring_index("rel", "/", -1))


def library_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing without the columns that ``listed`` makes of root and rel."""
    base = _over_items(spark, sf_dir, LIBRARY_BODY)
    return base.select("root", "rel", "size", "modified", F.sha2("content", 256).alias("sha256"))


def listed(rows: DataFrame, path: str = "path") -> DataFrame:
    return rows.withColumns({
        path: F.concat("root", F.lit("/"), "rel"), "name": F.substring_index("rel", "/", -1),
        "ord": F.concat(F.substr("root", F.lit(5)), F.lit("\x01"), F.translate("rel", "/", "\x01")),
    })


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(library_rows(spark, sf_dir)).select("path", "root", "rel", "name", "size", "modified", "sha256", "ord")


# --- titles ------------------------------------------------------------------------------
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document, whole, as (series, author, ord)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return (
        docs.select("doc_id", "source", F.posexplode(F.split("text", r"[.\n]")).alias("pos", "sentence"))
        .select(
            F.btrim("sentence").alias("series"), F.col("source").alias("author"),
            F.struct("doc_id", "pos").alias("ord"),
        )
        .where("series != ''")
    )


# --- archive members ------------------------------------------------------------------------
# Lines of documents as member paths with the shapes archives show: title folders, images, nested archives,
# unsafe paths.  source = archive, one member per line, whose letters are the name.
_LINES_SQL = """(SELECT source, lang, s[i] AS line, doc_id * 1000000 + i - 1 AS m
      FROM (SELECT source, lang, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS t(i))"""
_SHELF = {
    "shape": [
        ("m % 9 = 0", "'../' || stem || '.jpg'"),
        ("m % 9 = 1", "folder || '/' || stem || '.jpg'"),
        ("m % 9 = 2", "folder || '/' || stem || ' v' || CAST(m % 40 AS VARCHAR(9)) || '.zip'"),
        ("m % 9 = 3", "folder || '/IMG_' || CAST(m AS VARCHAR(20)) || '.PNG'"),
        ("m % 9 = 4", "stem || ' 第' || CAST(m % 12 AS VARCHAR(9)) || '巻.rar'"),
        ("m % 9 = 5", "folder || '/'"),
        ("m % 9 = 6", "folder || '/sub/' || stem || '.webp'"),
        ("m % 9 = 7", "'scans/' || CAST(m AS VARCHAR(20)) || '.jpg'"),
        ("m % 9 = 8", "folder || '/' || stem || '.7z'"),
    ],
}
_SHELF_BODY = f"""
SELECT source || '.zip' AS archive, m AS ordinal, 0 AS depth, CAST(length(line) AS BIGINT) AS size,
       {_case(_SHELF['shape'])} AS name
FROM (SELECT m, source, line, lang || ' ' || source || ' tales' AS folder,
             regexp_replace(line, '[^A-Za-zÀ-ÖØ-öø-ÿŒœ]+', ' '{{g}}) AS stem
      FROM {{documents}}) d"""
SHELF_SQL = _SHELF_BODY.format(documents=_LINES_SQL, g=", 'g'")
# Folders and steps up to any depth; how far a path climbs out is known from its numbers.
_DEEP_BODY = """
SELECT source || '.zip' AS archive, m AS ordinal, 0 AS depth, repeat('d/', CAST(m % 21 AS INT)) || repeat('../', CAST(m % 23 AS INT)) || 'p' || CAST(m AS VARCHAR(20)) || '.jpg' AS name,
       m % 23 > m % 21 AS climbs
FROM {documents} d"""
DEEP_SQL = _DEEP_BODY.format(documents=_LINES_SQL)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")
    return docs.select("source", "lang", "doc_id", lines).withColumn("m", F.col("doc_id") * 1000000 + F.col("pos")).drop("doc_id", "pos")


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    return spark.sql(_SHELF_BODY.replace("{g}", ""), documents=lines).withColumn("is_dir", F.col("name").endswith("/"))


def deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_DEEP_BODY, documents=document_lines(spark, sf_dir))


# --- jobs and events ---------------------------------------------------------------------------
JOBS_BODY = """
SELECT o_orderkey AS id, o_custkey AS owner,
       CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'running'
            ELSE CASE o_orderkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' ELSE 'cancelled' END END AS state,
       CASE o_orderpriority WHEN '5-LOW' THEN 'rename-zip' ELSE 'rar-folder-split' END AS operation,
       o_orderdate AS created,
       CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN NULL
            ELSE o_orderdate + INTERVAL 30 SECOND END AS started,
       CASE WHEN o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey % 3 = 0) THEN NULL
            WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 90 SECOND
            ELSE o_orderdate + INTERVAL 10 SECOND END AS finished,
       CAST(floor(o_totalprice) AS BIGINT) * 100 AS bytes_read,
       CAST(floor(o_totalprice) AS BIGINT) * 90 AS bytes_written
FROM {orders}"""
JOBS_SQL = JOBS_BODY.format(orders="orders")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOBS_BODY, orders=table(spark, sf_dir, "orders"))


LOG_BODY = """
SELECT event_id AS line, ts AS time, 'job-' || CAST(user_id AS VARCHAR(20)) AS job_id, event_type AS stage,
       CAST(floor(value * 1048576) AS BIGINT) AS bytes_read,
       CAST(floor(value * 524288) AS BIGINT) AS bytes_written, props
FROM {events}"""
LOG_SQL = LOG_BODY.format(events="events")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOG_BODY, events=table(spark, sf_dir, "events"))
