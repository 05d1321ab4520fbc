import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import packing, token_files
from shelfmark.llm.tokens import Encoder

from .conftest import ODD

TEXTS = [
    "It's 'sabc don't  two\n\n spaces \t x ÀÉÎ İstanbul Straße é ２３ ½２ ﬁ x\xa0y \x1c z\x85q", " lead", "trail ", "\n", "a<|endoftext|>b <|STARTOFTEXT|>",
    "日本語 テキスト。", "ǅ ǆ ŉ ſ ﬀ K", "a_b c__d 1a2b", "''s 'S 'RE", "x" * 3000, "👩‍👧 ok", "a é ö,x",
] + [t for _, t in ODD if t]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_encoding(name):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    e = Encoder(path)
    for _ in range(2):  # with and without kept pieces
        for t in TEXTS:
            assert np.frombuffer(e.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:80]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, u in ((1, 0), (1, 7), (5, 5), (1000, 10**6), (3000, 2500), (700, 700)):
        v = np.sort(rng.integers(0, u + 1, n))
        code = token_files.EliasFano(token_files.EliasFano.encode(v, u))
        assert code.select(np.arange(n)).tolist() == v.tolist()
    n, u = 100_000, 10**8
    assert len(token_files.EliasFano.encode(np.sort(rng.integers(0, u, n)), u)) * 8 < n * (2 + np.log2(u / n) + 1)
    assert token_files.EliasFano(token_files.EliasFano.encode(np.array([], np.int64), 0)).n == 0


def test_token_files_read_back(spark, odd, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    files = token_files.write(odd, path, end_id=2, block_tokens=500)
    got = sorted(token_files.read(spark, files, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in ODD), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    want = Counter((d, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in ODD)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert token_files.read(spark, token_files.write(nothing, path, 2)).count() == 0


def test_pack_places_every_piece(spark, odd, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    packed = packing.pack(odd.repartition(3), path, 0, packing.Capacity(tokens=256), keep_ids=True)
    rows = packed.collect()
    want = Counter()
    for d, t in ODD:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want.update((d, p, s, tuple(ids[s:e])) for p, (s, e) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in rows) == want
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert by.setdefault(r.sequence_id, 0) == r.offset
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 256 and len(by) == -(-sum(by.values()) // 256)
    one = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert {s: len(r.ids) for s, r in one.items()} == by
    assert packing.pack(nothing, path, 0).count() == 0


def brute_best_fit(counts, cap, rule, w):
    """One bin after the other, one piece at a time."""
    full, bins = np.array(cap), []
    scale = np.array(w) / full
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            item = np.array([length, 1, length * length])
            fit = [i for i, b in enumerate(bins) if (b >= item).all()]
            if fit:
                key = (lambda i: (((bins[i] - item) * scale) ** 2).sum()) if rule == "norm" else (lambda i: -(bins[i] * scale * item * scale).sum())
                i = min(fit, key=key)
                bins[i] = bins[i] - item
            else:
                bins.append(full - item)
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("cap", [(64, None, None), (64, 3, None), (64, 10, 1500)])
def test_plan_obeys_every_capacity(rule, cap):
    rng = np.random.default_rng(5)
    capacity = packing.Capacity(*cap)
    counts = Counter(rng.integers(1, capacity.longest() + 1, 400).tolist())
    plan = packing.plan(counts, capacity, rule)
    length = np.array([k for k, n in counts.items() for _ in range(n)])
    number = np.array([i for n in counts.values() for i in range(n)])
    sequence, offset = plan.place(length, number)
    limit = capacity.vector()
    for s in range(plan.sequences):
        own = length[sequence == s][np.argsort(offset[sequence == s])]
        assert sorted(offset[sequence == s]) == [0, *np.cumsum(own)[:-1]]
        assert own.sum() <= limit[0] and len(own) <= limit[1] and (own**2).sum() <= limit[2]
    assert plan.sequences <= brute_best_fit(counts, limit, rule, (1.0, 1e-6, 1e-6)) + 1
