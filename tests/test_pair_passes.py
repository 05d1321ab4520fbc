"""Similarity joins in passes: ranges of lengths, and parts of a range, lose no pair and leave nothing behind."""

import os

from pyspark.sql import functions as F

from shelfmark.operators import pairs as P
from tests.test_pairs import brute_near, corpus, run_near


def test_passes_lose_no_pair(spark, monkeypatch):
    texts = corpus(7, "abcd", 30, prefix="the adventures of ")
    want = brute_near(texts, 0.90)
    monkeypatch.setattr(P, "HOT", 5)
    seen, kept, plain = [], [], P.stored
    ranges = P._length_ranges
    monkeypatch.setattr(P, "_length_ranges", lambda ranked: seen.append(ranges(ranked)) or seen[-1])
    monkeypatch.setattr(P, "stored", lambda df: kept.append(plain(df)) or kept[-1])
    monkeypatch.setattr(P, "PASS_BYTES", 40_000)
    assert run_near(spark, texts, 0.90) == want
    assert any(len(r) > 1 for r in seen)
    # What the passes leave are pairs; the ranked texts are gone, unless a single pass reads them later.
    left = [t for t in kept if os.path.exists(t._stored_at)]
    assert sum("front" in t.columns for t in left) == sum(len(r) == 1 and r[0][2] == 1 for r in seen)
    assert all(set(t.columns) == {"scope", "a", "b", "sim"} for t in left if "front" not in t.columns)


def test_one_step_of_lengths_is_split_by_hash(spark, monkeypatch):
    monkeypatch.setattr(P, "PASS_BYTES", 15_000)
    texts = [t[:50] for t in corpus(8, "abc", 40) if len(t) >= 44] + [f"the same long shared beginning of all {i:03d} names" for i in range(30)]
    texts = sorted(set(texts))
    ranked = P._ranked_grams(spark.createDataFrame([("", t) for t in texts if len(t) >= 41], "scope string, text string"), 0.1, 8)
    ranges = P._length_ranges(ranked)
    assert any(parts > 1 for _, _, parts in ranges)
    lengths = {r.n for r in ranked.select(F.length("text").alias("n")).distinct().collect()}
    assert all(sum(low <= n < high for low, high, _ in ranges) == 1 for n in lengths)
    assert run_near(spark, texts, 0.90) == brute_near(texts, 0.90)
