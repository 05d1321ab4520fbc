import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import hard_negatives as H
from shelfmark.llm import lexical
from tests.llm.conftest import ODD
from pyspark.sql import functions as F

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for d, c, size in held:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item_id, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, term string") if isinstance(docs, list) else docs
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(lexical.index(d), i, **how).collect()), key=repr)


def test_search_beside_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 8, 30, 200])))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)] + [(7, docs[7][1]), (None, docs[9][1]), (-3, "Größe, ÉTÉ w1-W2"), (2000, "w1 " * 5000)]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(25)] + [(90, docs[7][1]), (90, docs[7][1]), (90, "w1 größe"), (91, None), (92, "!!"), (None, "w2 w3"), (93, "unseen")]
    want = brute_search(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, block_terms=20) == want
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 16)
    monkeypatch.setattr(lexical, "SEGMENT_WORDS", 500)
    index = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    if index.where("term IS NULL").count() > 20:  # the workers may hold the module as it was
        assert sorted((tuple(r) for r in lexical.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr) == want


def test_segments_one_by_one():
    """Strata, bounds and ties over many small segments, without Spark."""
    rng = random.Random(9)
    docs = [(i, [f"w{rng.randrange(40)}".encode() for _ in range(rng.choice([1, 2, 5, 40]))]) for i in range(300)]
    n, total = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    queries = [([f"w{j}".encode() for j in rng.sample(range(45), 6)]) for _ in range(30)]
    weighed = [(q, [lexical.weight(df[t], n) if t in df else 0 for t in q]) for q in queries]
    best = lexical.Best(len(queries), 5)
    for lo in range(0, 300, 23):
        vocabulary = lexical._Vocabulary()
        part = docs[lo : lo + 23]
        symbols = [np.array([vocabulary[w] for w in words]) for _, words in part]
        postings = {}
        for b in lexical._segment("s", [d for d, _ in part], symbols, vocabulary):
            for r in b.to_pylist():
                if r["term"] is None:
                    ids, m = np.frombuffer(r["ids"], np.int64), lexical.normaliser(np.frombuffer(r["lengths"], np.int64), n, total)
                else:
                    postings[r["term"]] = np.frombuffer(r["docs"], np.uint32), np.frombuffer(r["tfs"], np.uint32)
        lexical._search_segment(m, ids, postings, weighed, best)
    want = brute_search([(d, b" ".join(w).decode()) for d, w in docs], [(i, b" ".join(q).decode()) for i, q in enumerate(queries)], 5)
    assert sorted(((q, r, d, -s) for q, rows in enumerate(best.rows) for r, (s, d) in enumerate(rows, 1)), key=repr) == want


def test_search_of_odd_and_empty_tables(spark, odd, nothing):
    items = [(1, "alpha beta"), (2, "same w5"), (3, "日本語")]
    assert searched(spark, odd, items) == brute_search(ODD, items)
    assert searched(spark, nothing, items) == []
    assert searched(spark, odd, []) == []


def brute_mine(rows, every=100, positives=5, negatives=10, low=30, high=90):
    held = []
    for vec_id, label, x in rows:
        if label is not None and x is not None and all(c is not None and math.isfinite(c) and abs(256 * c) <= H.MOST for c in x):
            held.append((vec_id, label, [math.floor(256 * c) for c in x]))
    rank = lambda xs: sorted(xs, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
    out = []
    for a in {(v, l, tuple(x)): None for v, l, x in held if v is not None and v % every == 0}:
        scored = [(v, sum(p * q for p, q in zip(a[2], x)), l) for v, l, x in held if v != a[0]]
        for p, ps, _ in rank([s for s in scored if s[2] == a[1]])[:positives]:
            fit = [s for s in scored if s[2] != a[1] and low * ps <= 100 * s[1] <= high * ps]
            out += [(a[0], p, r, v, ps, s) for r, (v, s, _) in enumerate(rank(fit)[:negatives], 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id long, label int, embedding array<float>, code string, align double")
    return sorted((tuple(r) for r in H.mine(H.vectors(df, F.col("label")), **how).collect()), key=repr)


def vectors(n, width, seed, classes=4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((classes, width))
    return [(i, i % classes, [float(np.float32(c)) for c in (centre[i % classes] * 0.6 + rng.standard_normal(width)) / math.sqrt(width)]) for i in range(n)]


def test_mining_beside_brute_force(spark):
    rows = vectors(700, 64, 1)
    same = rows[3][2]
    rows += [(1000 + i, i % 3, same) for i in range(60)] + [(300, 0, rows[300][2]), (400, 2, rows[5][2]), (400, 2, rows[5][2])]
    rows += [(2000, None, same), (2001, 1, None), (2002, 1, [1.0, None]), (2003, 1, [float("nan")] * 64), (2004, 1, [float("inf")]), (2005, 1, [3e38] * 64), (None, 1, same), (2100, 1, []), (2200, 3, same[:9])]
    assert mined(spark, rows) == brute_mine(rows)


@pytest.mark.parametrize("width", [3, 70])
def test_mining_other_widths_and_counts(spark, monkeypatch, width):
    monkeypatch.setattr(H, "BLOCK", 3)  # the driver cuts the blocks
    rows = vectors(150, width, 2, classes=3)
    assert mined(spark, rows, every=10, positives=2, negatives=3, low=10, high=80) == brute_mine(rows, 10, 2, 3, 10, 80)


def test_mining_empty(spark):
    assert mined(spark, vectors(3, 8, 3), every=1000) == brute_mine(vectors(3, 8, 3), 1000)
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert H.mine(H.vectors(df, F.col("label"))).collect() == []


def test_intervals_hold_every_score():
    rng = np.random.default_rng(4)
    for width in (64, 128):
        a, b = rng.integers(-300, 300, (40, width)).astype(np.int32), rng.integers(-300, 300, (200, width)).astype(np.int32)
        a[0], b[0], b[1] = 0, 0, a[1]
        turn = H.rotation(width)
        least, most = H.Estimator(a, turn).intervals(H.encode(b, turn))
        exact = a.astype(np.int64) @ b.T
        assert (least <= exact).all() and (exact <= most).all()
        middle = np.corrcoef(((least + most) / 2).ravel(), exact.ravel())[0, 1]
        assert middle > 0.7 and ((most - least) < 2 * np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)) + 1).all()
