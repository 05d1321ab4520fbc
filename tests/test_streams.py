import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from shelfmark.operators.cluster import alias_index
from shelfmark.sources.versioned import VersionedTable
from shelfmark.streaming import live

DAY = datetime(2020, 1, 1)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- versioned table ------------------------------------------------------------------------------
def test_commits_replace_rows_by_key(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", "k string, n int", "k", buckets=3)
    make = lambda rows: spark.createDataFrame(rows, "k string, n int")
    assert rows_of(t.read()) == [] and t.last_commit() is None
    assert t.merge(make([("a", 1), ("b", 1), ("c", 1)]), commit=4)
    assert t.merge(make([("b", 2), ("d", 2)]), commit=5)
    now = [("a", 1), ("b", 2), ("c", 1), ("d", 2)]
    assert rows_of(t.read()) == now and rows_of(t.read(1)) == [("a", 1), ("b", 1), ("c", 1)]
    assert not t.merge(make([("a", 9)]), commit=5) and not t.merge(make([("a", 9)]), commit=4)
    assert t.merge(make([]), commit=6) and rows_of(t.read()) == now and t.last_commit() == 6
    assert t.merge(make([("e", 7)])) and t.last_commit() == 6
    assert t.vacuum(keep=1) >= 1 and rows_of(t.read()) == [*now, ("e", 7)] and t.versions() == [4]


def test_a_commit_that_fails_or_loses_changes_nothing(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", "k string, n int", "k")
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    t.merge(df, commit=0)

    class Dies(VersionedTable):
        def _publish(self, *a):
            raise OSError("lost")

    with pytest.raises(OSError):
        Dies(spark, f"{tmp_path}/t", "k string, n int", "k").merge(df.selectExpr("k", "n + 1 AS n"), commit=1)
    assert rows_of(t.read()) == [("a", 1)] and t.last_commit() == 0
    with pytest.raises(RuntimeError):
        t._publish(1, 1, {})
    assert t.merge(df.selectExpr("k", "n + 5 AS n"), commit=1) and rows_of(t.read()) == [("a", 6)]


# --- intake ---------------------------------------------------------------------------------------
ARRIVAL = "name string, size bigint, modified timestamp, sha256 string"


def arrival(name, size=10, day=0, sha="x"):
    return name, size, DAY + timedelta(days=day), sha


def test_batches_meet_what_earlier_batches_made(spark, tmp_path):
    t = live.catalogue(spark, f"{tmp_path}/t", buckets=2)
    none = alias_index(spark.createDataFrame([], "alias string, canonical string"))

    def put(batch_id, *rows):
        df = spark.createDataFrame(rows, ARRIVAL)
        done = live.intake_upsert(df, batch_id, none, t, "/out", f"{tmp_path}/d")
        return done, {r["name"]: (r["series"], r["decision"]) for r in spark.read.parquet(f"{tmp_path}/d/batch={batch_id}").collect()}

    done, first = put(0, arrival("[A] New Tale v1.zip"), arrival("[A] NEW TALE v2.zip"), arrival("[A] New Tale v1.zip", 12, 3, "y"), arrival("[A] New Tale v1.zip", 12, 1, "y"))
    assert done and len({s for s, _ in first.values()}) == 1
    kept = {r["path"]: (r["size"], r["sha256"], r["batch"]) for r in t.read().collect()}
    folder = first["[A] New Tale v1.zip"][0]
    assert kept == {f"/out/{folder}/[A] New Tale v1.zip": (12, "y", 0), f"/out/{folder}/[A] NEW TALE v2.zip": (10, "x", 0)}
    verdicts = sorted((r["size"], r["decision"]) for r in spark.read.parquet(f"{tmp_path}/d/batch=0").where("name LIKE '%v1.zip'").collect())
    assert verdicts == [(10, "keep-existing"), (12, "exact-duplicate"), (12, "use-candidate")]
    done, second = put(1, arrival("[A] new tale v3.zip"), arrival("[A] New Tale v1.zip", 12, 9, "y"), arrival("[A] NEW TALE v2.zip", 99, 1, "z"))
    assert done and {s for s, _ in second.values()} == {folder}
    assert second["[A] New Tale v1.zip"][1] == "exact-duplicate" and second["[A] NEW TALE v2.zip"][1] == "use-candidate"
    before = rows_of(t.read())
    assert put(1, arrival("[A] New Tale v9.zip"))[0] is False and rows_of(t.read()) == before


# --- throttle -------------------------------------------------------------------------------------
def brute_kept(stage, sizes, said, last, every):
    keep = []
    for s, n in zip(stage, sizes):
        changed = s != 0 and s != said
        hit = changed or n - last >= every
        said, last = (s if changed else said), (n if hit else last)
        keep.append(hit)
    return keep, said, last


def test_kept_events_beside_the_plain_walk():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(0, 40)
        stage = np.array([rng.choice([0, 0, 1, 2, 3]) for _ in range(n)], np.int32)
        sizes = np.array([rng.randrange(100) for _ in range(n)], np.int64)
        said, last = rng.randrange(4), rng.randrange(50)
        keep, s, k = live.kept_events(stage, sizes, said, last, 15)
        assert (keep.tolist(), s, k) == brute_kept(stage.tolist(), sizes.tolist(), said, last, 15)


def test_state_outlives_a_restart_and_chunks(spark, tmp_path):
    """One hot job in several chunks, out of order, over three runs from one checkpoint."""
    from checks.q_events import finished, settings

    rng = random.Random(8)
    log = [("hot" if rng.random() < 0.7 else f"j{rng.randrange(4)}", DAY + timedelta(seconds=i), i, rng.choice(["", "read", "write", None]), rng.randrange(400), rng.randrange(400)) for i in range(1200)]
    schema = "job_id string, time timestamp_ntz, line bigint, stage string, bytes_read bigint, bytes_written bigint"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for part in (log[:500], log[500:501], log[501:]):
            rng.shuffle(part)
            spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/log")
            arriving = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
            with settings(spark, stateStore_providerClass=live.ROCKSDB, noDataMicroBatches_enabled="false"):
                finished(
                    live.throttled_stream(arriving, 150).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/kept")
                    .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
                )
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    codes = {"": 0, None: 0, "read": 1, "write": 2}
    want = []
    for job in {r[0] for r in log}:
        own = sorted((r for r in log if r[0] == job), key=lambda r: r[2])
        keep, *_ = brute_kept([codes[r[3]] for r in own], [max(r[4], r[5]) for r in own], 0, 0, 150)
        want += [(job, r[2]) for r, k in zip(own, keep) if k]
    assert sorted((r["job_id"], r["line"]) for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == sorted(want)
