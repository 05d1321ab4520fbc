"""Tables with a row per file: compressed, and gone once the next one is written."""

import os

from pyspark.sql import functions as F

from shelfmark.operators import dedupe as D
from shelfmark.operators import stable as T
from shelfmark.operators.ordered import row_numbers
from shelfmark.plans.reconcile import base_items, with_destination


def test_only_the_result_of_the_steps_stays(spark):
    seen = []

    def build():
        first = T.stored(spark.range(1000).withColumn("path", F.concat(F.lit("/lib/a very long folder name/"), "id")))
        second = T.stored(first.groupBy("path").agg(F.max("id").alias("id")))
        seen.extend([first, second])
        return second.where("id % 2 = 0")

    out = T.settled(build)
    assert [os.path.exists(t._stored_at) for t in seen] == [False, False]
    assert out.count() == 500
    assert T.stored(out) is out
    inner = spark.conf.get(T.SHUFFLE_CLEANUP)
    assert inner == "false"


def test_known_hashes_are_joined_by_their_group(spark):
    rows = [
        ("/a", 5, "w", "e", "h1", False, 1, "move"), ("/b", 5, "w", "e", "h1", True, 9, "move"), ("/c", 5, "w", "e", "h1", False, 9, "move"),
        ("/d", 5, "w", "e", "h2", False, 1, "move"), ("/e", 5, "w", "e", None, False, 1, "move"), ("/f", 5, "w", "e", None, False, 2, "move"),
        ("/g", 5, None, None, "h1", False, 2, "error"), ("/h", -1, "w", "e", "h1", False, 2, "move"), ("/i", -1, "w", "e", "h1", False, 2, "move"),
    ]
    items = spark.createDataFrame(
        rows, "source string, size long, work_key string, edition string, sha256 string, quarantined boolean, t long, action string"
    ).withColumns({
        "modified": F.timestamp_seconds("t"), "ord": F.col("source"), "destination": F.col("source"), "reason": F.lit("r"),
        "duplicate_of": F.lit(None).cast("string"),
    })
    by_group = D.mark_exact_copies(items, lambda r: r)
    hashes = items.select("source", "sha256")
    read = D.exact_duplicates(items.drop("sha256"), lambda r: r.join(hashes, "source"))
    by_path = D.mark_duplicates(items, read)
    cols = ["source", "action", "destination", "reason", "duplicate_of"]
    got = sorted(map(repr, by_group.select(*cols).collect()))
    assert got == sorted(map(repr, by_path.select(*cols).collect()))
    kept = {r.source: (r.action, r.duplicate_of) for r in by_group.collect()}
    assert kept["/a"] == ("duplicate", "/c") and kept["/b"] == ("keep", "/c") and kept["/i"] == ("move", None)


def test_numbered_rows_go_once_they_are_used(spark):
    T.ensure_checkpoint_dir(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    listed = lambda: {os.path.join(at, n) for at, dirs, _ in os.walk(top) for n in dirs if n.startswith(("stored-", "rdd-"))}
    before = listed()
    rows = spark.range(3000).select(F.concat(F.lit("g"), F.col("id") % 3).alias("g"), "id")
    out = T.settled(lambda: row_numbers(rows, ["g"], [F.col("id")], "n"))
    assert [r.n for r in out.where("g = 'g1'").orderBy("id").limit(3).collect()] == [1, 2, 3]
    assert len(listed() - before) == 1


def test_destinations_are_made_of_source_and_series(spark):
    rows = spark.createDataFrame([("/lib0/a/x.zip", "s", "a/x.zip"), ("/lib0/y.zip", "", "y.zip")], "path string, series string, rel string")
    items = base_items(rows, "/lib0")
    again = with_destination(items.drop("destination"), "/lib0").select(*items.columns)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, items.collect()))
    assert [r.destination for r in again.orderBy("source").collect()] == ["/lib0/s/x.zip", None]
