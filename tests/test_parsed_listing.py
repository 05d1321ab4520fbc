"""Names of a listing are read part by part, each distinct part once."""

from pyspark.sql import functions as F

from shelfmark.functions import naming as N
from shelfmark.functions import rx
from shelfmark.functions import text as T

NAMES = [
    None, "", ".zip", "[a] ", "[Ann×Bob] ★★ story 第3巻 [DL版].zip", "[Ann×Bob] story 第3巻 [DL版].rar", "(一般コミック) [Cy] story v02.ZIP",
    "story v02.cbz", "story 1-3 (フルカラー).zip", "x/y.b/story_4 p12.zip", "【Dee】story story.part1.rar", "story.v2", "Unknown", "[Cy] .zip", "a.b/c",
]


def test_parts_of_names_join_back_to_the_same_rows(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES * 3)], "i int, name string")
    for existing in (False, True):
        want = N.with_parsed_name(rows, "name", existing=existing, reasons=True).collect()
        got = N.with_parsed_listing(rows, "name", existing=existing, reasons=True, names=rows.union(rows)).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_a_title_in_many_files_is_read_once(spark):
    files = spark.range(2000).select(F.concat(F.lit("["), F.col("id") % 40, F.lit("] story v"), F.col("id") % 9, F.lit(".zip")).alias("name"))
    plan = N.with_parsed_listing(files, "name")._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    tables = [x for x in (leaves.apply(i) for i in range(leaves.size())) if "Relation" in x.nodeName()]
    paths = [x.relation().location().rootPaths().head().toString() for x in tables]
    assert sorted(spark.read.parquet(p).count() for p in paths) == [9, 40]


def test_extensions_without_patterns(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES + ["a.", ".", "a.b.c", "a/b", "a.Z/", "ä.ÄÖ"]], "name string")
    n = F.col("name")
    for r in rows.select(
        T.extension(n).alias("e"), F.lower(F.regexp_extract(n, rx.EXTENSION, 0)).alias("we"),
        T.without_extension(n).alias("w"), F.regexp_replace(n, rx.EXTENSION, "").alias("ww"),
    ).collect():
        assert (r.e, r.w) == (r.we, r.ww)
