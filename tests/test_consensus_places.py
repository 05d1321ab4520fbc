"""A consensus needs the order of its candidates, not their numbers."""

from shelfmark.operators import members as M


def test_consensus_does_not_number_its_candidates(spark, monkeypatch):
    names = [
        "b tales/The Quiet Harbor v01.zip", "b tales/The Quiet Harbor v02.zip", "a tales/", "a tales/Quiet Harbour 3.jpg", "A Tales/IMG_7.png",
        "z/Loud Valley v09.7z", "z/the quiet harbor v01.ZIP", "静かな港 第4巻.rar", "静かな港 第5巻.rar", "z/静かな港 第4巻.zip",
    ]
    rows = [(f"{a}.zip", i, n) for a, part in (("x", names), ("y", names[:7]), ("w", names[5:6] + names[3:4])) for i, n in enumerate(part)]
    e = spark.createDataFrame(rows, "archive string, ordinal bigint, name string")
    e = e.selectExpr("*", "endswith(name, '/') AS is_dir", "CAST(1 AS BIGINT) AS size", "0 AS depth")
    archives = e.select("archive").distinct()
    whole = {r.archive: r for r in M.name_consensus(archives, M.name_candidates(e)).collect()}
    monkeypatch.setattr(M, "row_numbers", lambda *a: (_ for _ in ()).throw(AssertionError("numbered")))
    placed = {r.archive: r for r in M.name_consensus(archives, M.placed_candidates(e)).collect()}
    assert placed == whole and len(whole["x.zip"].candidates) > 1
    bare = {r.archive: r for r in M.name_consensus(archives, M.placed_candidates(e), names=False).collect()}
    assert {k: {c: v for c, v in r.asDict().items() if c != "candidates"} for k, r in whole.items()} == {k: r.asDict() for k, r in bare.items()}
