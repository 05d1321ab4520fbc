import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import bloom, exact_dedup, line_dedup, simhash

from .conftest import ODD


def least(ids):
    known = [x for x in ids if x is not None]
    return min(known) if known else None


def test_exact_classes_with_odd_rows(odd, nothing):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ODD]
    got = exact_dedup.classes(odd, bucket_bytes=8).collect()
    want = Counter((d, least([e for (e, _), m in zip(ODD, norm) if m == n]), norm.count(n)) for (d, _), n in zip(ODD, norm))
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(set(norm))
    assert exact_dedup.classes(nothing).count() == 0


def test_directory_doubles_until_buckets_fit():
    loads = np.zeros(1 << exact_dedup.DEPTH, np.int64)
    loads[[0, 1, 40_000]] = 10
    d = exact_dedup.Directory(loads, 15)
    assert d.depth == exact_dedup.DEPTH  # 0 and 1 part at the last bit
    keys = np.array([0, 1 << 48, 40_000 << 48], np.uint64).view(np.int64)
    assert len(set(d.bucket(keys).tolist())) == 3
    assert exact_dedup.Directory(loads, 100).bucket(keys).tolist() == [0, 0, 0]


def test_chain_compares_bytes():
    import pyarrow as pa

    rows = lambda *x: [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*x), exact_dedup._ENTRY)], schema=exact_dedup._ENTRY)]
    entry = lambda key, sha, text, n, doc_id, salt: (key, sha, text, n, doc_id is None, doc_id, 0, salt)
    out = list(exact_dedup._chain(rows(
        entry(1, "a", "x", 2, 7, 0), entry(1, "b", "y", 1, 3, 0), entry(1, "a", "x", 1, 5, 0), entry(1, "a", "other", 1, None, 0), entry(2, "c", "z", 1, None, 0), entry(3, "d", "w", 4, 9, 1),
    )))
    got = [(r["key"], r["sha"], r["place"], r["n"], r["doc_id"], r["text"], r["twin"]) for b in out for r in b.to_pylist()]
    assert got == [
        (1, "a", 0, 3, 5, "x", True), (1, "b", 1, 1, 3, None, False), (1, "a", 2, 1, None, "other", True), (2, "c", 0, 1, None, None, False),
        (3, "d", 0, 4, 9, "w", False),
    ]


@pytest.mark.parametrize("key_bits, digest_bits", [(4, 4), (0, 0), (64, 1), (2, 256)])
def test_classes_are_exact_where_hashes_collide(spark, key_bits, digest_bits):
    """The owners tell texts apart by their bytes, whatever the key and the digest say."""
    rows = [(i % 900 if i % 11 else None, f"text {i % 150}" if i % 3 else "hot  text") for i in range(1500)] + [(4, "text 7"), (4, "text 7"), (2, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << key_bits)) if key_bits < 64 else F.xxhash64(c)
    digest = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(1 << digest_bits)).cast("string") if digest_bits < 256 else F.sha2(c, 256)
    got = exact_dedup.classes(docs, key=key, digest=digest).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    size, ids = Counter(norm), {n: least([d for (d, _), m in zip(rows, norm) if m == n]) for n in set(norm)}
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((d, ids[n], size[n]) for (d, _), n in zip(rows, norm))
    assert sum(r.kept for r in got) == len(size) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_heavy_keys_are_shared_out(spark):
    rows = [(i, "hot text" if i % 3 else f"own {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = exact_dedup.classes(docs).where("group_size > 1").agg(F.count("*").alias("n"), F.min("keep_id").alias("k"), F.sum(F.col("kept").cast("int")).alias("s")).first()
    assert (got.n, got.k, got.s) == (sum(i % 3 > 0 for i, _ in rows), 1, 1)


def test_bloom_twice_holds_what_two_tasks_saw():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b[:500] = a[:500]
    parts = []
    for x in (a, b):
        pair = bloom.Pair(bloom.bits_for(6000))
        pair.add(x)
        parts += list(pair.slices())
    parts.sort(key=lambda p: p["slice"][0].as_py())
    import zlib

    twice = np.concatenate([np.frombuffer(zlib.decompress(p["twice"][0].as_py()), np.uint8) for p in bloom._merge(iter(parts))])
    assert bloom.within(twice, a[:500]).all()
    assert bloom.within(twice, a[500:]).mean() < 0.05


def lines_brute(rows, min_docs, keep):
    keys = [line_dedup.keys_of(t) for _, t in rows]
    n = Counter(k for _, ks in keys for k in set(ks) if k)
    drop = {k for k, c in n.items() if c >= min_docs}
    rank = lambda i: (rows[i][0] is None, rows[i][0] or 0, xxhash.xxh64_intdigest(rows[i][1]) >> 1)
    first = {k: min(rank(i) for i, (_, ks) in enumerate(keys) if k in ks) for k in drop} if keep == "first" else {}
    out = []
    for i, (lines, ks) in enumerate(keys):
        left, mine = [], set()
        for line, k in zip(lines, ks):
            if k in drop:
                if not first or k in mine or rank(i) != first[k]:
                    continue
                mine.add(k)
            left.append(line.decode())
        out.append((rows[i][0], "\n".join(left), len(lines), len(lines) - len(left)))
    return Counter(out)


@pytest.mark.parametrize("broadcast", [1 << 20, -1])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_lines_both_ways(spark, odd, nothing, broadcast, keep):
    rows = ODD + [(100 + i, f"Shared line\nown {i}\n  shared LINE \n\n") for i in range(12)] + [(50, "shared line")]
    extra = spark.createDataFrame(rows[len(ODD) :], "doc_id long, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    out = line_dedup.deduplicated(docs, min_docs=3, keep=keep, broadcast_bytes=broadcast)
    assert set(docs.columns) <= set(out.columns)
    got = Counter((r.doc_id, r.text or "", r._n_lines, r._n_dropped) for r in out.collect())
    assert got == lines_brute(rows, 3, keep)
    assert line_dedup.deduplicated(nothing, 2, keep, broadcast).count() == 0


def brute_components(rows):
    prints = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3).tolist():
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return [least([rows[j][0] for j in range(len(rows)) if root[j] == root[i]]) for i in range(len(rows))]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_and_survivors(spark, odd, nothing):
    assert [simhash.fingerprint(t) for _, t in ODD if t is None or len(t) < 999] == [plain_fingerprint(t) for _, t in ODD if t is None or len(t) < 999]
    got = simhash.components_of(odd).collect()
    want = Counter(zip([d for d, _ in ODD], [f"{simhash.fingerprint(t):016x}" for _, t in ODD], brute_components(ODD)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.survivors(odd)
    assert kept.columns == odd.columns
    prints = {f"{simhash.fingerprint(t):016x}": c for (_, t), c in zip(ODD, brute_components(ODD))}
    assert kept.count() == len(set(prints.values()))
    assert simhash.components_of(nothing).count() == simhash.survivors(nothing).count() == 0


def test_simhash_forest_is_exact_for_a_large_sliced_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 20)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    prints = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(60)})
    df = spark.createDataFrame([(simhash.signed(x),) for x in prints], "_print long")
    links = {(r.a, r.b) for r in simhash.linked(df).collect()}
    back = lambda x: x & (1 << 64) - 1
    assert all((back(a) ^ back(b)).bit_count() <= 3 for a, b in links)
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(back(a))] = find(back(b))
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                assert find(a) == find(b)


def test_masks_cover_all_close_pairs():
    for blocks, distance in ((6, 3), (4, 3), (5, 1)):
        m = simhash.masks(blocks, distance)
        rng = np.random.default_rng(3)
        for _ in range(200):
            diff = sum(1 << int(k) for k in rng.choice(64, distance, replace=False))
            assert any(diff & x == 0 for x in m)


@pytest.mark.parametrize("broadcast", [1 << 20, -1])
@pytest.mark.parametrize("most_bits", [12 * 60, 12 * 5000])
def test_lines_by_ranges(spark, most_bits, broadcast):
    """Filters that hold far fewer lines than there are: same rows, and hardly a line is suspected without need."""
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(40)] + [f"shared {i % 150}", "Hot line", f"pair {i // 2}"])) for i in range(300)] + [(7, None), (None, "hot LINE"), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = line_dedup.deduplicated(docs, min_docs=2, keep="none", broadcast_bytes=broadcast, most_bits=most_bits)
    got = Counter((r.doc_id, r.text or "", r._n_lines, r._n_dropped) for r in out.collect())
    assert got == Counter((d, t, n, k) for (d, t, n, k), c in lines_brute(rows, 2, "none").items() for _ in range(c))
    filters = list(line_dedup._suspects(docs, most_bits))
    assert (len(filters) > 1) == (most_bits == 12 * 60)
    truth = {k for k, c in Counter(k for _, t in rows for k in set(line_dedup.keys_of(t)[1]) if k).items() if c > 1}
    found = Counter(k for f in filters for _, t in rows for k in set(f.of(t)))
    assert truth <= set(found) and len(set(found)) <= 1.05 * len(truth) + 5
    assert all(found[k] == sum(k in line_dedup.keys_of(t)[1] for _, t in rows) for k in truth)
