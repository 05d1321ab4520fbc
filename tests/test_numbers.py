"""Numbers read from names: rows without a match cost no failed cast."""

from pyspark.sql import functions as F

from shelfmark.functions import naming as N
from shelfmark.functions.text import digits_value, whole_number


def test_numbers_of_matches(spark):
    df = spark.createDataFrame([("",), ("7",), ("００12",), (None,), ("99999999999",), ("x",)], "s string")
    got = df.select(digits_value(F.col("s")).alias("d"), whole_number(F.col("s")).alias("w")).collect()
    assert [r.d for r in got] == [None, 7, 12, None, None, None]
    assert [r.w for r in got] == [None, 7, None, None, 99999999999, None]


def test_coverage_patterns_run_less_often(spark):
    df = N.with_coverage(spark.createDataFrame([("a 2-5巻",), ("b 第3話-第8話",), ("c",), ("d ch 9-4",)], "t string"), "t").select("t", "coverage.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # 17 in the plan when each number was written out at each of its uses.
    assert plan.count("regexp_extract(") <= 12
    got = {r.t: (r.kind, r.volume_start, r.volume_end, r.chapter_start, r.chapter_end, r.label) for r in df.collect()}
    assert got == {
        "a 2-5巻": ("volume", 2, 5, 0, 0, "巻 2–5"), "b 第3話-第8話": ("chapter", 0, 0, 3, 8, "話 3–8"), "c": ("", 0, 0, 0, 0, ""),
        "d ch 9-4": ("chapter", 0, 0, 4, 9, "話 4–9"),
    }
