"""Saved aliases and verdicts belong to spellings, not to files."""

from pyspark.sql import functions as F

from shelfmark.operators import cluster as C


def test_aliases_are_looked_up_by_spelling_and_not_by_file(spark, monkeypatch):
    asked, real = [], C.with_alias

    def counting(df, *args):
        asked.append(df.count())
        return real(df, *args)

    monkeypatch.setattr(C, "with_alias", counting)
    rows = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "Old Name").when(F.col("id") % 3 == 1, "Quiet Harbor").otherwise("").alias("series"),
        F.lit("").alias("author"), F.format_string("%04d", "id").alias("ord"),
    )
    index = spark.createDataFrame([("oldname", "New Name")], "key string, canonical string")
    got = C.clustered(rows, index).groupBy("series", "cluster.reason").count().collect()
    assert asked == [3]
    assert {(r.series, r.reason, r["count"]) for r in got} == {
        ("New Name", "saved alias", 100), ("Quiet Harbor", got_reason(got), 100), ("", None, 100),
    }


def got_reason(rows):
    return next(r.reason for r in rows if r.series == "Quiet Harbor")
