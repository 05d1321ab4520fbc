"""A report is its planned rows beside a table of exceptions; what a row gives by itself is neither numbered nor joined."""

from pyspark.sql import functions as F

from checks import q_reconcile as Q
from shelfmark.operators import manifest as M
from shelfmark.plans import reconcile as R


def _leaving(spark, sources):
    return spark.createDataFrame([(s, "S", s, "duplicate") for s in sources], "source string, series string, ord string, action string")


def test_only_names_that_are_not_free_are_numbered(spark, monkeypatch):
    seen, real = [], M.row_numbers
    monkeypatch.setattr(M, "row_numbers", lambda df, groups, order, out: seen.append(df.count()) or real(df, groups, order, out))
    sources = [f"/r/n{i}.zip" for i in range(40)] + ["/r/a/x.zip", "/r/b/x.zip", "/r/y.v1 (2)", "/r/z.zip"]
    files = spark.createDataFrame([(f"/a/.quarantine/S/{n}",) for n in ("y.v1 (2)", "z (2).zip", "q.zip")], "path string")
    got = {r.source: r.quarantine_path for r in M.leaving_paths(_leaving(spark, sources), files, "/a").collect()}
    assert got == {"/r/b/x.zip": "/a/.quarantine/S/x (2).zip", "/r/y.v1 (2)": "/a/.quarantine/S/y (2).v1 (2)"}
    assert seen == [4, 2]  # x twice, y and z for the numbers that are taken


def test_quarantine_destinations_of_plain_and_numbered_names(spark):
    files = spark.createDataFrame([("/a/.quarantine/S/x.zip",)], "path string")
    items = _leaving(spark, ["/r/x.zip", "/r/y.zip"]).withColumn("destination", F.lit("/a/S/home"))
    rest = items.limit(1).withColumns({"source": F.lit("/r/k.zip"), "action": F.lit("move")})
    got = {r.source: r.destination for r in M.with_quarantine_destinations(items.unionByName(rest), files, "/a").collect()}
    assert got == {"/r/x.zip": "/a/.quarantine/S/x (2).zip", "/r/y.zip": "/a/.quarantine/S/y.zip", "/r/k.zip": "/a/S/home"}


def test_a_manifest_older_than_its_listing(spark):
    rows = [
        ("/r/a.zip", "/a/S/a.zip", "move"), ("/r/b.zip", "/a/S/b.zip", "move"), ("/a/S/b.zip", "/a/.quarantine/S/b.zip", "duplicate"),
        ("/r/c.zip", "/a/S/c.zip", "move"), ("/r/d.zip", "/a/S/d.zip", "move"), ("/gone.zip", "/a/S/d.zip", "superseded"), ("/r/e.zip", "/a/S/e.zip", "move"),
        ("/r/f.zip", "/a/S/e.zip", "duplicate"),
    ]
    items = spark.createDataFrame(rows, "source string, destination string, action string").withColumns({"series": F.lit("S"), "volume": F.lit(1)})
    files = spark.createDataFrame([(r[0],) for r in rows if r[0] != "/gone.zip"] + [("/a/S/c.zip",)], "path string")
    got = {r.path: (r.new_path, r.outcome) for r in M.apply_manifest(files, items).collect()}
    assert got == {
        "/r/a.zip": ("/a/S/a.zip", "moved"), "/r/b.zip": ("/a/S/b.zip", "moved"), "/a/S/b.zip": ("/a/.quarantine/S/b.zip", "quarantined"),
        "/r/c.zip": ("/r/c.zip", "skipped"), "/a/S/c.zip": ("/a/S/c.zip", "kept"), "/r/d.zip": ("/a/S/d.zip", "moved"),
        "/r/e.zip": ("/r/e.zip", "skipped"), "/r/f.zip": ("/a/S/e.zip", "quarantined"),
    }


def test_names_are_read_of_a_listing_without_what_rel_gives(spark):
    rels = ["Quiet Harbor/(Ann) Quiet Harbor v03.zip", "batch 7/(Ann) Quiet Harbors v04 [DL版].zip", "loose 第5巻.rar", "x/readme.txt"]
    rows = spark.createDataFrame([("/lib0", r) for r in rels], "root string, rel string")
    wide = rows.withColumns({"path": F.concat_ws("/", "root", "rel"), "name": F.substring_index("rel", "/", -1), "ord": F.col("rel")})
    slim = R.named_files(rows)
    cols = slim.columns
    assert not {"path", "name", "ord"} & set(cols)
    assert sorted(map(repr, slim.collect())) == sorted(map(repr, R.named_files(wide).select(*cols).collect()))


def test_slim_tables_keep_destinations_that_are_not_the_home(spark):
    rows = [("/lib0", "q/x.zip", "S", "review", "/lib0/q/x.zip"), ("/lib0", "y.zip", "S", "move", "/lib0/S/y.zip"), ("/lib0", "z.zip", "", "error", None)]
    items = spark.createDataFrame(rows, "root string, rel string, series string, action string, destination string")
    items = items.withColumns({"source": F.concat_ws("/", "root", "rel"), "name": F.substring_index("rel", "/", -1)})
    back = Q.SLIM.settled(lambda: items, "source")
    assert sorted(map(repr, back.select(*items.columns).collect())) == sorted(map(repr, items.collect()))


def test_pages_are_put_in_ranges_once(spark, monkeypatch, tmp_path):
    from pyspark.sql.classic.dataframe import DataFrame

    from shelfmark.sources import reports as P

    ranged, real = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda df, *keys: ranged.append(keys) or real(df, *keys))
    df = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("n"))
    P.write_pages(df, [F.col("n")], f"{tmp_path}/p")
    assert len(ranged) == 1
    assert [(r.position, r.n) for r in P.read_page(spark, f"{tmp_path}/p", 2990, 20).collect()] == [(i, i) for i in range(2990, 3010)]


def test_plain_conflicts_carry_only_places_and_actions(spark, monkeypatch):
    out = Q.OUT
    rows = [("/b/x.zip", f"{out}/S/x.zip", "h1", 1), ("/b/y.zip", f"{out}/S/y.zip", "h2", 2), (f"{out}/S/x.zip", f"{out}/S/x.zip", "h3", 3),
            ("/c/z.zip", f"{out}/S/z.zip", "h4", 4), (f"{out}/S/z.zip", f"{out}/T/z.zip", "h5", 5), ("/d/z.zip", f"{out}/T/k.zip", "h5", 6)]
    items = spark.createDataFrame(rows, "source string, destination string, sha256 string, t long").withColumns({
        "work_key": F.lit("w"), "edition": F.lit("e"), "size": F.lit(5).cast("long"), "modified": F.timestamp_seconds("t"), "ord": F.col("source"),
        "quarantined": F.lit(False), "action": F.when(F.col("source") == F.col("destination"), "keep").otherwise("move"),
        "reason": F.lit("r"), "duplicate_of": F.lit(None).cast("string"),
    })
    seen, real = [], Q.D.conflicts
    monkeypatch.setattr(Q.D, "conflicts", lambda marked, files: seen.append(marked.columns) or real(marked, files))
    monkeypatch.setattr(Q, "plain_items", lambda spark, sf: items)
    monkeypatch.setattr(Q, "lib", lambda spark, sf: items.select(F.col("source").alias("path")))
    found = lambda name: {tuple(r) for r in Q.QUERIES[name](spark, "tiny").select("source", "destination").collect()}
    assert found("destination_conflicts") == {("/b/x.zip", f"{out}/S/x.zip")}
    assert found("vacated_conflicts") == {("/c/z.zip", f"{out}/S/z.zip")}
    assert seen == [["source", "destination", "action"]] * 2
