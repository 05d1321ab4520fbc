"""Series of a listing, counted without a row per file."""

from pyspark.sql import functions as F

from shelfmark.functions import naming as N
from shelfmark.functions.text import trimmed
from shelfmark.operators import cluster as C
from shelfmark.plans import reconcile as R


def listing(spark, n):
    folder = F.element_at(F.array(*map(F.lit, ["", "Red Bolt Story/", "batch 7/", ".quarantine/red bolt story/", "★ red bolt story/", "a/b/Cold Ring/"])), (F.col("id") % 6 + 1).cast("int"))
    title = F.element_at(F.array(*map(F.lit, ["red bolt story", "Red_Bolt Storys", "12", "cold ring story spin-off", "　cold ring "])), (F.col("id") % 5 + 1).cast("int"))
    rel = F.concat(folder, F.lit("[Author "), F.col("id") % 4, F.lit("×Brand] "), title, F.lit(" v"), (F.col("id") / 30).cast("int"), F.lit(".zip"))
    rows = spark.range(n).select(F.lit("/lib0").alias("root"), rel.alias("rel")).withColumn("path", F.concat("root", F.lit("/"), "rel"))
    return rows.withColumns({"name": F.substring_index("rel", "/", -1), "ord": F.col("rel")})


def test_series_files_equal_named_files(spark, monkeypatch):
    files = listing(spark, 3000)
    assert files.select("path").distinct().count() == 3000
    named = R.named_files(files).where("series <> ''")
    want = named.groupBy("series", "author").agg(F.min("ord").alias("ord"), F.count("*").alias("files"))
    sizes = []
    plain = R.stored
    monkeypatch.setattr(R, "stored", lambda df: sizes.append(plain(df)) or sizes[-1])
    got = R.series_files(files)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert sizes and max(t.count() for t in sizes) < 300
    names = lambda rows: sorted(map(repr, C.distinct_names(rows).select("series", "ord", "files").collect()))
    assert names(got) == names(named.select("series", "author", "ord"))
    assert sorted(C.author_evidence(got).collect()) == sorted(C.author_evidence(named).collect())


def test_only_folders_with_a_say_are_kept(spark):
    series = ["red bolt story", "12", "abcdefghij", "cold ring"]
    folders = ["Red Bolt Story", "batch 7", "abcdefghi", "abcdefghijklm", "xabcdefghij", "cold ring 赤い輪", "12", "abcdefghix"]
    pairs = spark.createDataFrame([(s, f) for s in series for f in folders], "series string, folder string")
    got = {(r.series, r.folder): r for r in R.parent_verdicts(pairs).collect()}
    profiles = N.with_profile(N.with_profile(pairs.withColumn("parent", N.legacy_folder_name(F.col("folder"))), "parent", "p"), "series", "n")
    p, n = F.col("p"), F.col("n")
    ok = N.series_usable(F.col("folder")) & p["usable"]
    agrees = ok & n["usable"] & ((N.pair_score(n, p)["score"] >= 0.90) | N.is_subtitle_prefix(n, p))
    want = {(r.series, r.folder): r for r in profiles.select("series", "folder", agrees.alias("agrees"), (ok & ~n["usable"]).alias("stands_in")).collect()}
    assert {k for k, r in want.items() if r.agrees or r.stands_in} == set(got)
    assert all((r.agrees, r.stands_in) == (want[k].agrees, want[k].stands_in) for k, r in got.items())
    assert ("abcdefghij", "abcdefghix") in got and ("red bolt story", "batch 7") not in got


def test_trims_of_name_parts(spark):
    names = [" a b .zip", "　[x]　y　.zip", "[x].zip", "x", "", " ", "[a] [b]  c ", "\tq.rar"]
    df = N._with_name_parts(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    for r in df.withColumn("again", trimmed(F.col("_body"))).collect():
        assert r._body == r.again
