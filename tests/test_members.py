import random
import re

import pytest
from shelfmark.operators import members as M


def sequential(names):
    """The plain rule, entry by entry."""
    seen, out = set(), []
    for name in names:
        ext = re.search(r"\.[^./]*\Z", name)
        stem, ext = (name[: ext.start()], ext[0]) if ext else (name, "")
        pick, n = name, 1
        while pick.lower() in seen:
            n += 1
            pick = f"{stem} ({n}){ext}"
        seen.add(pick.lower())
        out.append(pick)
    return out


def unique(spark, by_archive):
    rows = [(a, i, n) for a, names in by_archive.items() for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "archive string, ordinal bigint, name string")
    got = M.unique_members(df).collect()
    assert len(got) == len(rows)
    out = {a: {} for a in by_archive}
    for r in got:
        out[r["archive"]][r["ordinal"]] = r["unique_name"]
    return {a: [x[i] for i in range(len(x))] for a, x in out.items()}


def test_random_mixed_families(spark):
    """Many small archives whose names take each other's numbers, at several depths, at once."""
    rng = random.Random(11)

    def name():
        n = rng.choice(["a", "A", "b", "p/a"])
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            n += f" ({rng.choice([1, 2, 2, 2, 3, 3, 4, 5, '02', 12])})"
        return n + rng.choice([".jpg", ".jpg", ".JPG", "", ".tar (2)"])

    archives = {f"x{k}": [name() for _ in range(rng.randrange(1, 60))] for k in range(60)}
    archives["hot"] = ["cover.jpg" if rng.random() < 0.6 else f"cover ({rng.randrange(2, 400)}).jpg" for _ in range(900)]
    archives["late"] = ["c.jpg"] * 50 + [f"c ({n}).jpg" for n in range(2, 40)] + ["c.jpg"] * 30
    archives["early"] = [f"c ({n}).jpg" for n in range(40, 1, -1)] + ["c.jpg"] * 60 + ["c (2).jpg"] * 5
    got = unique(spark, archives)
    for a, names in archives.items():
        assert got[a] == sequential(names), a
        assert len({n.lower() for n in got[a]}) == len(names)


def test_no_entries(spark):
    assert M.unique_members(spark.createDataFrame([], "archive string, ordinal bigint, name string")).collect() == []


@pytest.mark.parametrize("level", [3])
def test_deep_numbers(spark, level):
    base = "t" + " (2)" * level
    names = [f"{base}.png"] * 3 + [f"t{' (2)' * k}.png" for k in range(level, -1, -1)] * 3
    assert unique(spark, {"a": names})["a"] == sequential(names)
