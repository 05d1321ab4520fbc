"""Sources and sinks on real files; streams; ordered windows; components."""

import os
import random
import zipfile
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import members as M
from shelfmark.operators.components import components
from shelfmark.operators.dedupe import file_sha256
from shelfmark.operators.ordered import running_total, with_previous
from shelfmark.sources import aliases, archives, listing, reports


def test_listing_roots_and_quarantine(spark, tmp_path):
    for rel in ("a/S/x.zip", "a/S/y.part2.rar", "a/.quarantine/S/q.zip", "b/z.zip"):
        os.makedirs(tmp_path / os.path.dirname(rel), exist_ok=True)
        (tmp_path / rel).write_bytes(b"data" * 3)
    roots = [f"{tmp_path}/a/", f" {tmp_path}/b ", f"{tmp_path}/a"]
    files = listing.list_files(spark, roots)
    assert {r.rel for r in files.collect()} == {"S/x.zip", "S/y.part2.rar", "z.zip"}
    full = listing.list_files(spark, roots, include_quarantine=True)
    assert {r.rel for r in full.where(listing.in_quarantine(F.col("rel"))).collect()} == {".quarantine/S/q.zip"}
    assert {r.rel for r in files.where(listing.is_library_archive(F.col("name"))).collect()} == {"S/x.zip", "z.zip"}
    assert {r.rel for r in listing.inbox(files).collect()} == {"z.zip"}
    hashed = file_sha256(files.select("path"))
    assert {r.sha256 for r in hashed.collect()} == {sha256(b"data" * 3).hexdigest()}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        listing.normalise_roots(["relative"])


def test_nested_archives_are_listed(spark, tmp_path):
    inner, outer, broken = tmp_path / "i.zip", tmp_path / "o.zip", tmp_path / "b.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("p/1.jpg", b"x")
        z.writestr("p/2.jpg", b"xx")
    with zipfile.ZipFile(outer, "w") as z:
        z.write(inner, "Title v1.zip")
        z.writestr("bad.zip", b"not a zip")
    broken.write_bytes(b"nope")
    df = spark.createDataFrame([("o", str(outer)), ("b", str(broken))], "archive string, path string")
    rows = archives.list_members(df).collect()
    names = {r.logical for r in rows if r.archive == "o" and r.error is None}
    assert names == {"Title v1.zip", "bad.zip", "Title v1/p/1.jpg", "Title v1/p/2.jpg"}
    assert sum(r.error is not None for r in rows) == 2


def test_member_facts_and_groups(spark):
    rows = [("w", 0, i, n, False, 5) for i, n in enumerate(["Root/A/1.jpg", "Root/A/2.jpg", "Root/b.jpg"])]
    rows += [("r", 0, 0, "Only/1.jpg", False, 5), ("z", 0, 0, "x.zip", False, 9)]
    e = spark.createDataFrame(rows, "archive string, depth int, ordinal bigint, name string, is_dir boolean, size bigint")
    facts = {r.archive: r for r in M.archive_facts(e).collect()}
    assert facts["w"].common_root == "Root" and facts["z"].single_nested_zip and facts["z"].common_root == ""
    groups = {(r.archive, r.group, r.files) for r in M.split_groups(e).collect()}
    assert groups == {("w", "A", 2), ("w", "", 1), ("r", "Only", 1), ("z", "", 1)}


def test_unique_members_follow_the_sequential_rule(spark):
    names = ["a.jpg", "A.jpg", "a (2).jpg", "a.jpg", "b.jpg", "B.JPG", "a (2).jpg"]
    e = spark.createDataFrame([("x", i, n) for i, n in enumerate(names)], "archive string, ordinal bigint, name string")
    got = [r.unique_name for r in M.unique_members(e).orderBy("ordinal").collect()]
    assert got == ["a.jpg", "A (2).jpg", "a (2) (2).jpg", "a (3).jpg", "b.jpg", "B (2).JPG", "a (2) (3).jpg"]


def test_pages_round_trip(spark, tmp_path):
    df = spark.range(1001).select((F.lit(1000) - F.col("id")).alias("n"))
    reports.write_pages(df, [F.col("n")], f"{tmp_path}/p")
    got = [r.n for r in reports.read_page(spark, f"{tmp_path}/p", offset=195, limit=10).collect()]
    assert got == list(range(195, 205))
    assert reports.page_bounds(5, 9999) == (5, 10004)
    for bad in ((-3, 1), (0, 0)):
        with pytest.raises(ValueError):
            reports.page_bounds(*bad)


def test_alias_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"root": "/x", "series_aliases": {" Old ": "New/Name", "gone": " "}}')
    assert [tuple(r) for r in aliases.read_settings(spark, f"{tmp_path}/s.json").collect()] == [("Old", "New Name")]


def test_running_totals_and_neighbours(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(8)
    want, last, prev = {}, {}, {}
    for k, i, v in rows:
        want[i], prev[i] = last.get(k, (0, None))[0] + v, last.get(k, (0, None))[1]
        last[k] = (want[i], v)
    assert {r.i: r.t for r in running_total(df, ["k"], [F.col("i")], F.col("v"), "t").collect()} == want
    assert {r.i: r.prev_v for r in with_previous(df, ["k"], [F.col("i")], ["v"]).collect()} == prev


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("s000", f"s{i:03d}") for i in range(1, 40)] + [("y", "x")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert {v for k, v in got.items() if k[0] == "c"} == {"c000"} and {v for k, v in got.items() if k[0] == "s"} == {"s000"}
    assert got["y"] == "x" and len(got) == 61 + 40 + 2
