"""Names in, expected columns out."""

from pyspark.sql import functions as F

from shelfmark.functions import naming as N
from shelfmark.functions.text import clean_path
from shelfmark.operators.members import clean_member, is_unsafe

#: Name, series, author, volume.  Each line stands for one rule; the last column of the comment names it.
RAW = [
    ("灯台日和.zip", "灯台日和", "", None),  # nothing but a title
    ("灯台日和 21.rar", "灯台日和", "", 21),  # a number at the end
    ("灯台日和 v11.cbz", "灯台日和", "", 11),  # short volume mark
    ("Harbor Lights Vol.9.zip", "Harbor Lights", "", 9),  # long volume mark
    ("Harbor Lights v04b.zip", "Harbor Lights", "", 4),  # letter behind the number
    ("[森野] Harbor Lights 第05巻.zip", "Harbor Lights", "森野", 5),  # author in square brackets
    ("【森野】灯台日和 第０３巻 限定版.rar", "灯台日和", "森野", 3),  # wide digits, edition tail
    ("[漫画][森野] 灯台日和 第08巻.zip", "灯台日和", "森野", 8),  # metadata tag first
    ("[Raw]【森野】灯台日和 第10巻.rar", "灯台日和", "森野", 10),  # metadata tag in Latin letters
    ("[森野(North Pier)×K.T] 雨の図書室、はじめました！ 第02巻", "雨の図書室、はじめました！", "森野(North Pier)×K.T", 2),  # two authors
    ("雨の図書室_ch31", "雨の図書室", "", None),  # chapter tail
    ("雨の図書室 7 - p012 [scanner]", "雨の図書室", "", 7),  # page tail
    ("雨の図書室 単行本", "雨の図書室", "", None),  # edition words
    ("雨の図書室 コミックス", "雨の図書室", "", None),
    ("塩と星図 塩と星図 第06巻.zip", "塩と星図", "", 6),  # doubled title
    ("塩と星図 4巻 再スキャン.zip", "塩と星図", "", 4),  # variant tail
    ("塩と星図 第07巻 [モノクロ版].zip", "塩と星図", "", 7),
    ("塩と星図 第09巻 fixed.zip", "塩と星図", "", 9),
    ("塩と星図 おまけ.zip", "塩と星図", "", None),
    ("塩と星図 外伝.zip", "塩と星図", "", None),  # a bare side-story word goes
    ("塩と星図 異聞 ～羅針盤の子ら～ 第01巻.zip", "塩と星図 異聞 ～羅針盤の子ら～", "", 1),  # a named one stays
    ("夜汽車の、Ｊと猫！ 第03-05巻s.zip", "夜汽車の、Ｊと猫！", "", None),  # a range is no volume
]
EXISTING = [
    ("[森野] 灯台日和 第05巻.zip", "灯台日和", 5),
    ("灯台日和 外伝 第06巻.zip", "灯台日和", 6),
    ("[森野×汐見] 塩と星図　4巻　再スキャン.zip", "塩と星図", 4),
    ("[森野×汐見] 塩と星図　5巻 セミカラー版.zip", "塩と星図", 5),
    ("[森野] 灯台日和 再スキャン　7巻.zip", "灯台日和", 7),
    ("[森野] 灯台日和 第03-04巻s.zip", "灯台日和", None),
    ("[森野] 灯台日和 v03-04.zip", "灯台日和", None),
    ("[森野] 灯台日和 第０３～０４巻.zip", "灯台日和", None),
    ("[森野] 灯台日和 v08w.zip", "灯台日和", 8),
]
COVERAGE = [
    ("灯台日和 第02巻-第17巻.zip", "volume", 2, 17, 0, 0, "巻 2–17"),
    ("灯台日和 001-045巻.rar", "volume", 1, 45, 0, 0, "巻 1–45"),
    ("灯台日和 ch.010-099.zip", "chapter", 0, 0, 10, 99, "話 10–99"),
    ("灯台日和 第3話-第28話.rar", "chapter", 0, 0, 3, 28, "話 3–28"),
]
SAME = [
    ("HARBOR_LIGHTS", "Harbor Lights", 0.99),
    ("HARBOR LIGHTS", "HARBOR LIGHTS ハーバー・ライツ", 0.97),
    ("ハーバーライツ", "ハーバーライツ Harbor Lights", 0.97),
    ("図書室の司書はいつもねむたい", "図書室の司書はいつもねむたぃ", 0.90),
]


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_raw_names(spark):
    df = spark.createDataFrame(RAW, "name string, s string, a string, v int")
    rows = N.with_parsed_name(df, "name", reasons=True).collect()
    got = [(r.name, r.parsed.series, r.parsed.author, r.parsed.volume) for r in rows]
    assert got == RAW
    assert all(r.parsed.has_volume == (r.parsed.volume is not None) for r in rows)
    assert rows[7].parsed.reasons == ["metadata-prefix", "author-prefix", "explicit-japanese-volume", "non-empty-series"]


def test_existing_names(spark):
    df = spark.createDataFrame(EXISTING, "name string, s string, v int")
    assert [(r.name, r.parsed.series, r.parsed.volume) for r in N.with_parsed_name(df, "name", existing=True).collect()] == EXISTING


def test_removing_tails_again_changes_nothing(spark):
    names = [r[0] for r in RAW] + ["T (bonus) [DL版] (モノクロ) 単行本 fixed 特典 番外編 再スキャン 修正版 [DL] (extra)"]
    once = column(spark, names, N.strip_editions_and_variants)
    assert column(spark, once, N.strip_editions_and_variants) == once
    assert once[-1] == "T"


def test_coverage(spark):
    df = spark.createDataFrame([(c[0],) for c in COVERAGE], "name string")
    assert [(r.name, *r.coverage) for r in N.with_coverage(df, "name").collect()] == COVERAGE
    lone = spark.createDataFrame([("灯台日和 第05巻.zip",)], "name string")
    assert N.with_coverage(lone, "name").first().coverage.kind == ""
    assert N.with_coverage(lone, "name", literal_kind=False).first().coverage.label == "巻 5"


def test_merged_coverage(spark):
    rows = [(f"T 第{i}巻-第{i}巻",) for i in range(1, 151)]
    df = N.with_coverage(spark.createDataFrame(rows, "name string"), "name")
    assert df.agg(N.merged_coverage(F.col("coverage")).alias("m")).first().m.label == "巻 1–150"


def test_keys(spark):
    main = column(spark, ["雨の図書室"], N.group_key)[0]
    names = [f"雨の図書室 {w}" for w in ("フルカラー版", "セミカラー版", "モノクロ版", "再スキャン", "修正版", "番外編", "外伝", "おまけ")]
    assert set(column(spark, names, N.group_key)) == {main}
    assert column(spark, ["a/b:c*?"], N.safe_folder_name) == ["a b c"]
    assert column(spark, ["Ｈａｒｂｏｒ　Lights！"], N.canonical_key) == ["harborlights"]


def test_usable_and_ratings(spark):
    assert column(spark, ["表紙", "Preview", "第14巻", "X�Y tale", "", "塩と星図"], N.series_usable) == [False] * 5 + [True]
    assert column(spark, ["★★ 塩と星図", "塩と星図 ⭐", "ほしぞら★キャラバン"], lambda c: N.rating_split(c)["count"]) == [2, 1, 0]
    assert column(spark, ["塩と星図 ★"], lambda c: N.with_rating(c, N.rating_rank(N.rating_split(F.lit("★★ x"))))) == ["★★ 塩と星図"]


def test_pair_scores(spark):
    df = spark.createDataFrame(SAME + [("HARBOR LIGHTS", "塩と星図", 0.0)], "a string, b string, floor double")
    df = N.with_profile(N.with_profile(df, "a", "pa"), "b", "pb")
    rows = df.select("floor", N.pair_score(F.col("pa"), F.col("pb")).alias("s")).collect()
    assert all(r.s.score >= r.floor for r in rows) and rows[-1].s.score == 0


def test_editions_and_paths(spark):
    names = ["T セミカラー版 v1.zip", "T full-color.zip", "T モノクロ.zip", "T color.zip", "T.zip"]
    assert column(spark, names, N.edition_class) == ["semi-color", "full-color", "monochrome", "color", "standard"]


def test_paths_fold_at_any_depth(spark):
    import posixpath

    paths = ["/a//b/./c/", "/a/b/../c", "/../x", "a/../../b", "./x", "/a/b/c/../../d", "", ".", "/", "a/..", "../..", "a/./", "x/", "a/..b/...", "/..", "..", "a/b/."]
    paths += ["d/" * n + "../" * m + "etc/passwd" for n in range(0, 21, 4) for m in range(0, 23, 5)]
    assert column(spark, paths, clean_path) == [posixpath.normpath(p) for p in paths]
    assert column(spark, ["d/" * 9 + "../" * 10 + "etc/passwd"], lambda c: is_unsafe(clean_member(c))) == [True]
