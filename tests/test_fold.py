import random

from pyspark.sql import functions as F

from shelfmark.functions import naming as N
from shelfmark.operators import cluster as C


def test_names_in_order_beside_the_plain_fold(spark, monkeypatch):
    """Groups of names in one script, the other and both, so that the order decides; one group has most of the names."""
    rng = random.Random(6)
    jp, latin = ["銀河鉄道", "空の物語", "夜の王国"], ["galaxy line", "sky story", "royal"]
    names = sorted({a + rng.choice(["", " ", "　"]) + b for a in jp for b in ["", *latin]} | {b + " " + a for a in jp for b in latin} | {b + x for b in latin for x in ("", " two", "!")})
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(6)}", i, rng.choice(names)) for i in range(400)]
    df = N.with_profile(spark.createDataFrame(rows, "cluster string, ord bigint, name string"), "name", "p")
    profiles = df.select("name", "p").dropDuplicates(["name"])
    pairs = profiles.select(F.col("name").alias("x"), F.col("p").alias("px")).join(profiles.select(F.col("name").alias("y"), F.col("p").alias("py")))
    better = {(r["x"], r["y"]): r["b"] for r in pairs.select("x", "y", N.is_better_display(F.col("px"), F.col("py")).alias("b")).collect()}
    want = {}
    for group, _, name in rows:
        want[group] = name if group not in want or better[(name, want[group])] else want[group]
    cycles = sum(better[(a, b)] and better[(b, c)] and better[(c, a)] for a in names for b in names for c in names)
    assert cycles, "the comparison should not be transitive here"
    for size in (7, 256):
        monkeypatch.setattr(C, "FOLD_SLICE", size)
        assert {r["cluster"]: r["pick"] for r in C.display_fold(df.select("cluster", "ord", "p")).collect()} == want
    assert C.display_fold(df.limit(0).select("cluster", "ord", "p")).collect() == []


def test_links_stand_for_all_pairs(spark):
    """Class pairs and members give the pairs of the full list, also for many spellings of one key and for shared creators."""
    rng = random.Random(4)
    base = ["silver river story", "silver river storys", "silver river story the second arc", "golden gate", "golden gates of dawn", "銀河の物語", "銀河の物語 galaxy", "quiet harbour tale"]
    spell = [lambda s: s, str.upper, lambda s: s.replace(" ", "_"), lambda s: s.replace(" ", "-"), lambda s: s + " spin-off"]
    rows = [(rng.choice(spell)(rng.choice(base)), rng.choice(["", "Ann Lee", "Bo Ray", "Ann Lee×Bo Ray"]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "series string, author string, ord bigint")
    want = {frozenset((r["a"], r["b"])) for r in C.name_pairs(df).collect()}
    members, pairs = C.name_links(df)
    held = members.collect()
    linked = {frozenset((r["a"], r["b"])) for r in pairs.collect()}
    got = {
        frozenset((x["series"], y["series"])) for x in held for y in held
        if x["series"] < y["series"] and (x["key"] == y["key"] or frozenset((x["class"], y["class"])) in linked)
    }
    assert got == want and len(want) > 100
    assert {r["series"]: r["links"] for r in held} == {s: sum(s in p for p in want) for s in {r[0] for r in rows}}
