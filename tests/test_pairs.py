"""Blocked joins against brute force, on random near-copies and on a hot shared phrase."""

import random

from pyspark.sql import functions as F

from shelfmark.operators import pairs as P


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def mutate(rng, s, edits, alphabet):
    s = list(s)
    for _ in range(edits):
        i = rng.randrange(len(s) + 1)
        kind = rng.random()
        if kind < 0.34 and i < len(s):
            s[i] = rng.choice(alphabet)
        elif kind < 0.67:
            s.insert(i, rng.choice(alphabet))
        elif i < len(s):
            del s[i]
    return "".join(s)


def corpus(seed, alphabet, n=60, prefix=""):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        base = prefix + "".join(rng.choice(alphabet) for _ in range(rng.randint(6, 48)))
        out.add(base)
        for _ in range(3):
            out.add(mutate(rng, base, rng.randint(1, 5), alphabet))
    return sorted(x for x in out if x)


def brute_near(texts, floor):
    found = set()
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            la, lb = len(a), len(b)
            if min(la, lb) >= 10 and 1 - distance(a, b) / max(la, lb) >= floor:
                found.add((a, b))
    return found


def run_near(spark, texts, floor):
    df = spark.createDataFrame([("", t) for t in texts], "scope string, text string")
    return {(r.a, r.b) for r in P.near_pairs(df, floor).collect()}


def test_near_pairs_equal_brute_force(spark):
    for seed, alphabet in [(1, "abcdefgh"), (2, "ab"), (3, "あいうえおabc")]:
        texts = corpus(seed, alphabet, 40)
        for floor in (0.90, 0.86):
            assert run_near(spark, texts, floor) == brute_near(texts, floor)


def test_hot_grams_are_refined_without_loss(spark, monkeypatch):
    monkeypatch.setattr(P, "HOT", 5)
    texts = corpus(4, "abcd", 40, prefix="the adventures of ")
    for floor in (0.90, 0.86):
        assert run_near(spark, texts, floor) == brute_near(texts, floor)


def test_scopes_do_not_mix(spark):
    rows = [("x", "abcdefghijkl"), ("y", "abcdefghijkm"), ("x", "abcdefghijkn")]
    got = P.near_pairs(spark.createDataFrame(rows, "scope string, text string"), 0.90).collect()
    assert [(r.scope, r.a, r.b) for r in got] == [("x", "abcdefghijkl", "abcdefghijkn")]


def test_prefix_and_suffix_pairs(spark):
    texts = ["abcdef", "abcdefgh", "xxabcdef", "abcde", "abcdef zz"]
    df = spark.createDataFrame([("", t) for t in texts], "scope string, text string")
    for end in (False, True):
        fits = str.endswith if end else str.startswith
        want = {(a, b) for a in texts for b in texts if a != b and len(a) >= 6 and fits(b, a)}
        assert {(r.short, r.long) for r in P.prefix_pairs(df, df, 6, from_end=end).collect()} == want


def test_inserted_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    texts = set()
    for _ in range(40):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(9, 24)))
        i = rng.randrange(len(s) + 1)
        texts |= {s, s[:i] + "".join(rng.choice("abc") for _ in range(rng.randint(1, 10))) + s[i:]}
    texts = sorted(texts)
    df = spark.createDataFrame([("", t) for t in texts], "scope string, text string")

    def framed(a, b):
        return 10 <= len(a) < len(b) <= len(a) + 8 and any(b[:i] + b[len(b) - (len(a) - i):] == a for i in range(len(a) + 1))

    want = {(a, b) for a in texts for b in texts if framed(a, b)}
    assert {(r.short, r.long) for r in P.inserted_pairs(df).collect()} == want


def test_title_pairs_query_on_a_small_fixture(spark, tmp_path):
    from checks.q_reconcile import title_pairs

    texts = corpus(6, "abcdefg", 20)
    docs = [(i, ".".join(texts[i::7]), f"s{i}") for i in range(7)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b) for r in title_pairs(spark, str(tmp_path)).collect()}
    assert got == brute_near(texts, 0.90)
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.count("*")).first()[0] == 7
