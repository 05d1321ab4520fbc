"""Queries of flows that keep what earlier runs made: the catalogue that arrivals are merged into."""

from pyspark.sql import functions as F

from checks import sql_naming as S
from checks import views as V
from checks.memo import own_work
from checks.q_events import finished, scratch
from checks.q_reconcile import OUT
from shelfmark.operators.cluster import alias_index
from shelfmark.operators.stable import pinned
from shelfmark.streaming import live

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(fn):
        QUERIES[name] = own_work(fn)
        if sql:
            SQL[name] = sql
        return fn

    return put


# --- intake ---------------------------------------------------------------------------------------
# Two waves of arrivals.  Every second part belongs to a series that has no folder yet, which the second wave also spells in
# capitals; a third of the paths come again older, newer or of one age, with the same bytes or others.
_WAVES = """
SELECT wave, CASE WHEN wave = 1 AND p_partkey % 3 = 0 THEN upper(stem) ELSE stem END || ' v' || CAST(p_size AS VARCHAR(9)) || '.zip' AS name,
  CAST(p_size * 1000 + CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE wave * (p_partkey % 2) END AS BIGINT) AS size,
  CAST(DATE '2000-01-01' + CAST(p_size + CASE WHEN wave = 1 THEN p_partkey % 5 - 2 ELSE 0 END AS INT) AS {time}) AS modified,
  {sha} AS sha256
FROM (SELECT *, '[' || p_brand || '] ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' story' ELSE ' saga' END AS stem,
        p_name || '|' || CAST(p_size AS VARCHAR(9)) || '|' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(wave AS VARCHAR(9)) END AS content
      FROM {part} CROSS JOIN (VALUES (0), (1)) AS w(wave)) p"""


def _intake_sql():
    arrivals = _WAVES.format(part="part", sha="sha256(content)", time="TIMESTAMP")
    keyed = S.stage(f"SELECT * FROM ({S.parsed(arrivals, 'name')})", sk=S.canonical("p_series"))
    ctes = [
        ("lib", f"SELECT path, rel, size, CAST(modified AS TIMESTAMP) AS modified, sha256 FROM ({V.LIBRARY_SQL}) WHERE root = '{OUT}'"),
        ("k", keyed),
        ("f", "SELECT DISTINCT split_part(rel, '/', 1) AS folder FROM lib WHERE contains(rel, '/') AND NOT starts_with(rel, '.')"),
        ("g0", f"SELECT {S.canonical('folder')} AS sk, min(folder) AS folder FROM f GROUP BY 1"),
        ("g1", "SELECT * FROM g0 UNION ALL SELECT sk, min(p_series) FROM k WHERE wave = 0 AND sk NOT IN (SELECT sk FROM g0) GROUP BY 1"),
        ("g2", "SELECT * FROM g1 UNION ALL SELECT sk, min(p_series) FROM k WHERE wave = 1 AND sk NOT IN (SELECT sk FROM g1) GROUP BY 1"),
        ("a", f"SELECT wave, name, size, modified, sha256, count(*) AS arrivals, any_value(folder) AS series, '{OUT}/' || any_value(folder) || '/' || name AS path "
              "FROM k JOIN g2 USING (sk) GROUP BY 1, 2, 3, 4, 5"),
        ("old0", "SELECT path, size, modified, sha256, CAST(-1 AS BIGINT) AS batch FROM lib"),
    ]
    same = "{x}.size = o.size AND {x}.sha256 = o.sha256"
    for w in (0, 1):
        ctes += [
            (f"lead{w}", f"SELECT * FROM a WHERE wave = {w} QUALIFY row_number() OVER (PARTITION BY path ORDER BY modified DESC, size DESC, sha256 DESC) = 1"),
            (f"v{w}", f"SELECT l.path, l.size, l.modified, l.sha256, CASE WHEN o.path IS NULL THEN 'use-candidate' WHEN {same.format(x='l')} THEN 'exact-duplicate' "
                      f"WHEN l.modified > o.modified THEN 'use-candidate' ELSE 'keep-existing' END AS d FROM lead{w} l LEFT JOIN old{w} o USING (path)"),
            (f"old{w + 1}", f"SELECT * FROM old{w} WHERE path NOT IN (SELECT path FROM v{w} WHERE d = 'use-candidate') UNION ALL SELECT path, size, modified, sha256, {w} FROM v{w} WHERE d = 'use-candidate'"),
            (f"d{w}", f"SELECT a.*, CASE WHEN a.size = v.size AND a.modified = v.modified AND a.sha256 = v.sha256 THEN v.d WHEN {same.format(x='a')} THEN 'exact-duplicate' ELSE 'keep-existing' END AS decision "
                      f"FROM a JOIN v{w} v USING (path) JOIN old{w + 1} o USING (path) WHERE wave = {w}"),
        ]
    out = " UNION ALL ".join(f"SELECT d{w}.wave, name, series, path, decision, arrivals, o.batch AS held_by FROM d{w} JOIN old2 o USING (path)" for w in (0, 1))
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in ctes) + " " + out


@query("stream_intake_upsert", _intake_sql())
def stream_intake_upsert(spark, sf):
    """Two runs of one stream over a catalogue that starts as the library; each batch is then put in once more, which changes nothing."""
    folder = scratch(spark)
    table = live.catalogue(spark, f"{folder}/catalogue", buckets=8)
    listed = V.library(spark, sf).where(F.col("root") == OUT)
    table.merge(listed.select(
        "path", F.substring_index("rel", "/", 1).alias("series"), "name", F.lit(None).cast("int").alias("volume"), "size",
        F.col("modified").cast("timestamp").alias("modified"), "sha256", F.lit(-1).cast("long").alias("batch"),
    ), commit=-1)
    index = pinned(alias_index(spark.createDataFrame([], "alias string, canonical string")))
    waves = spark.sql(_WAVES.replace("{sha}", "sha2(content, 256)").replace("{time}", "TIMESTAMP"), part=V.table(spark, sf, "part"))
    for wave in (0, 1):
        rows = waves.where(F.col("wave") == wave).drop("wave")
        rows.write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        finished(live.start_intake_upsert(arriving, index, table, OUT, f"{folder}/decisions", f"{folder}/cp"))
        if live.intake_upsert(rows, wave, index, table, OUT, f"{folder}/decisions"):
            raise RuntimeError("a batch was merged twice")
    decided = spark.read.parquet(f"{folder}/decisions").withColumnRenamed("batch", "wave")
    held = table.read().select("path", F.col("batch").alias("held_by"))
    return decided.join(held, "path").select("wave", "name", "series", "path", "decision", "arrivals", "held_by")
