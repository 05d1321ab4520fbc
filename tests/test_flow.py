"""Clustering and reconcile scenarios: listings in, verdicts out."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfmark.operators import cluster as C
from shelfmark.operators import manifest as M
from shelfmark.plans import reconcile as R

T0 = datetime(2024, 1, 1)
SCHEMA = "root string, rel string, size bigint, modified timestamp, sha256 string"


def listing(spark, rows):
    """rows: (root, rel, size, hours, sha)"""
    data = [(r, p, s, T0 + timedelta(hours=h), sha) for r, p, s, h, sha in rows]
    df = spark.createDataFrame(data, SCHEMA)
    return df.select(
        F.concat_ws("/", "root", "rel").alias("path"), "root", "rel", F.substring_index("rel", "/", -1).alias("name"),
        "size", "modified", "sha256", F.concat("root", F.lit("\x01"), F.translate("rel", "/", "\x01")).alias("ord"),
    )


def run(spark, rows, **kw):
    return R.reconcile(listing(spark, rows), "/a", hasher=lambda d: d, **kw)


def by_source(report):
    return {r.source: r for r in report.items.collect()}


def clusters(spark, groups):
    """One clustering run over independent groups of (series, author)."""
    rows = [(s, a, f"{i:03d}") for i, (s, a) in enumerate(groups)]
    df = spark.createDataFrame(rows, "series string, author string, ord string")
    return {r.series: (r.canonical, r.reason) for r in C.cluster_names(df).collect()}


def test_clusters(spark):
    got = clusters(
        spark,
        [
            ("HARBOR LIGHTS", ""), ("HARBOR LIGHTS ハーバー・ライツ", ""), ("ハーバー・ライツ", ""),
            ("港町を出ていった見習い航海士", "森野×汐見"),
            ("港町を出ていった見習い航海士 外伝 アンナさんは船に弱い！？", "別作画×別構成"),
            ("待望の時計塔の番人の座を手に入れたぞ！", "森野×汐見"),
            ("待望の時計塔（からくり）の番人の座を手に入れたぞ！", "森野×汐見"),
            ("うらにわ菜園で小国再建記", "同一作者"),
            ("うらにわ菜園で小国再建記 ～ふえる畑と気ままな島ぐらし～", "同一作者"),
            ("仕立屋次男の立身ものがたり", "甲"), ("仕立屋次男の立身ものがたり はじまりの針", "乙"),
        ],
    )
    assert {got[s][0] for s in ("HARBOR LIGHTS", "HARBOR LIGHTS ハーバー・ライツ", "ハーバー・ライツ")} == {"ハーバー・ライツ"}
    assert got["港町を出ていった見習い航海士 外伝 アンナさんは船に弱い！？"][0] == "港町を出ていった見習い航海士"
    assert len({got[s][0] for s in got if s.startswith("待望")}) == 1
    assert len({got[s][0] for s in got if s.startswith("うらにわ")}) == 1
    assert got["仕立屋次男の立身ものがたり"] == ("仕立屋次男の立身ものがたり", None)


def test_saved_alias_wins_and_keeps_ratings(spark):
    aliases = spark.createDataFrame([("★ Old Name", "New Name"), ("old-name", "Other")], "alias string, canonical string")
    rows = spark.createDataFrame([("Old Name", "", "1"), ("★★ OLD NAME", "", "2")], "series string, author string, ord string")
    got = C.clustered(rows, C.alias_index(aliases)).collect()
    assert {r.series for r in got} == {"★★ Other"} or {r.series for r in got} == {"★★ New Name"}
    assert {r.cluster.reason for r in got} == {"saved alias"}


def test_reconcile_verdicts(spark):
    report = run(
        spark,
        [
            ("/a", "[作者] 甲の物語 第01巻.zip", 10, 1, "x"),            # older variant
            ("/b", "[作者] 甲の物語 第01巻.zip", 11, 5, "y"),            # newest
            ("/a", "[作者] 乙の物語 第02巻.zip", 12, 3, "p"),            # tie
            ("/b", "[作者] 乙の物語 第02巻.zip", 13, 3, "q"),            # tie
            ("/a", "丙の物語 第03巻.zip", 20, 1, "s"),                   # three editions stay
            ("/a", "丙の物語 第03巻 フルカラー版.zip", 21, 2, "t"),
            ("/a", "丙の物語 第03巻 セミカラー版.zip", 22, 3, "u"),
            ("/a", "丁の物語/丁の物語 第04巻.zip", 30, 1, "same"),        # exact copies
            ("/b", "丁の物語 第04巻.zip", 30, 9, "same"),
            ("/a", "戊の物語 第05巻.zip", 40, 1, "same2"),               # equal bytes, other work
            ("/a", "己の物語 第05巻.zip", 40, 1, "same2"),
            ("/a", "01.zip", 1, 1, "z"),                                  # no series
        ],
    )
    got = by_source(report)
    assert got["/b/[作者] 甲の物語 第01巻.zip"].auto_selected
    old = got["/a/[作者] 甲の物語 第01巻.zip"]
    assert (old.action, old.destination) == ("superseded", "/a/.quarantine/甲の物語/[作者] 甲の物語 第01巻.zip")
    assert {r.action for s, r in got.items() if "乙" in s} == {"review"} and report.choices.count() == 1
    assert {r.action for s, r in got.items() if "丙" in s} == {"move"}
    assert {r.edition for s, r in got.items() if "丙" in s} == {"standard", "full-color", "semi-color"}
    assert got["/a/丁の物語/丁の物語 第04巻.zip"].action == "duplicate"
    assert got["/b/丁の物語 第04巻.zip"].reason == "the file in its place is going"
    assert {got[f"/a/{n}の物語 第05巻.zip"].action for n in "戊己"} == {"move"}
    assert got["/a/01.zip"].action == "error"

    choice = report.choices.first().choice
    errors = M.selection_errors(report.items, report.choices, spark.createDataFrame([(choice, "/nowhere")], "choice string, selected string"))
    assert [r.problem for r in errors.collect()] == ["invalid selection"]
    chosen = spark.createDataFrame([(choice, "/b/[作者] 乙の物語 第02巻.zip")], "choice string, selected string")
    after = {r.source: r.action for r in M.apply_selections(report.items, chosen, "/a").collect()}
    assert after["/b/[作者] 乙の物語 第02巻.zip"] == "move" and after["/a/[作者] 乙の物語 第02巻.zip"] == "superseded"


def test_second_run_only_keeps(spark):
    files = [
        ("/a", "x/[作者] 甲の物語 第01巻.zip", 10, 1, "x"), ("/b", "[作者] 甲の物語 第01巻.zip", 11, 5, "y"),
        ("/b", "★★ 乙の物語 第02巻.zip", 12, 3, "p"), ("/a", "乙の物語/乙の物語 第03巻.zip", 13, 3, "q"),
    ]
    base = listing(spark, files)
    report = R.reconcile(base, "/a", hasher=lambda d: d)
    moved = M.apply_manifest(base, report.items).join(base.select("path", "size", "modified", "sha256"), "path")
    rows = [("/a" if r.new_path.startswith("/a/") else "/b", r.new_path[3:], r.size, int((r.modified - T0).total_seconds() // 3600), r.sha256) for r in moved.collect()]
    again = run(spark, rows)
    assert {r.action for r in again.items.collect()} == {"keep"}


def test_order_of_rows_does_not_matter(spark):
    rows = [(s, "作者", f"{i}") for i, s in enumerate(["Alpha Saga Tale", "ALPHA SAGA TALE", "Alpha Saga Tales", "alpha saga tale spin-off"])]
    df = spark.createDataFrame(rows, "series string, author string, ord string")
    a = {tuple(r) for r in C.cluster_names(df).drop("cluster").collect()}
    b = {tuple(r) for r in C.cluster_names(df.orderBy(F.desc("ord")).repartition(5)).drop("cluster").collect()}
    assert a == b and len({r[2] for r in a}) == 1


def test_quarantine_names_take_the_first_free_number(spark):
    files = listing(spark, [("/a", ".quarantine/S/n.zip", 1, 1, "x"), ("/a", ".quarantine/S/n (3).zip", 1, 1, "x")])
    planned = spark.createDataFrame([(f"/r{i}/n.zip", "S", str(i)) for i in range(3)], "source string, series string, ord string")
    got = [r.quarantine_path for r in M.quarantine_names(planned, files, "/a").orderBy("ord").collect()]
    assert got == ["/a/.quarantine/S/n (2).zip", "/a/.quarantine/S/n (4).zip", "/a/.quarantine/S/n (5).zip"]


def test_quarantine_names_beyond_five_digits(spark):
    full = [("/a", ".quarantine/S/n.zip", 1, 1, "x")] + [("/a", f".quarantine/S/n ({k}).zip", 1, 1, "x") for k in range(2, 10_003)]
    planned = spark.createDataFrame([("/r/n.zip", "S", "1")], "source string, series string, ord string")
    assert M.quarantine_names(planned, listing(spark, full), "/a").first().quarantine_path == "/a/.quarantine/S/n (10003).zip"
