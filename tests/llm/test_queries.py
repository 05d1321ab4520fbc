"""Registered queries without SQL, and the pipeline as a whole, beside plain Python on a small folder."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shelfmark.llm import queries

from .test_dedup import brute_components, lines_brute, plain_fingerprint
from .test_text import brute_contamination

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").orderBy("doc_id").collect()]


def token_ids(name, texts):
    t = Tokenizer.from_file(queries.tokenizer_file(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_simhash_query(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, TINY).collect()}
    assert got == {d: (f"{plain_fingerprint(t):016x}", c) for (d, t), c in zip(docs, brute_components(docs))}


def test_token_file_query(spark, docs):
    start, want = 0, []
    for (d, _), ids in zip(docs, token_ids("word_bpe_49k.json", [t for _, t in docs])):
        want.append((d, start, len(ids) + 1, crc([*ids, 2])))
        start += len(ids) + 1
    got = queries.op9_token_files(spark, TINY).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def packed_beside_plain(packed, docs):
    """Every piece once, as whole encodings give it, and sequences without gaps, as few as the tokens allow."""
    want, total = set(), 0
    for (d, _), ids in zip(docs, token_ids("byte_bpe_50k.json", [t for _, t in docs])):
        ids = [*ids, 0]
        total += len(ids)
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want |= {(d, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed} == want and len(packed) == len(want)
    spans = defaultdict(list)
    for r in packed:
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert -(-total // 2048) <= len(spans) <= -(-total // 2048) + 1


def test_packing_query(spark, docs):
    packed_beside_plain(queries.op10_best_fit_packing(spark, TINY).collect(), docs)


def test_the_whole_pipeline(spark, docs):
    kept = [(d, t) for d, t in docs if any(c.isalpha() for c in t or "")]
    lines = {d: t for d, t, *_ in lines_brute(kept, 10, "none")}
    kept = [(d, lines[d]) for d, _ in kept]
    firsts = set(brute_components(kept))
    kept = [(d, t) for d, t in kept if d in firsts]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    marks = {d: bad for d, *_, bad in brute_contamination(kept, items)}
    kept = [(d, t) for d, t in kept if not marks[d]]
    assert 0 < len(kept) < len(docs) and any(marks.values())
    packed_beside_plain(corpus_pipeline.run(spark, TINY).collect(), kept)


def test_language_query_beside_a_plain_model(spark, docs):
    """Word-first back-off by hand: the fold, the label set and the score's range of every row, and what a word decides."""
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    known = [(lang[d], t) for d, t in docs if zlib.crc32(str(d).encode()) % 5 and lang[d] is not None]
    share = defaultdict(Counter)
    for y, t in known:
        share[y].update(w for w in (t or "").lower().split())
    got = {r.doc_id: r for r in queries.op1_language_id(spark, TINY).collect()}
    assert set(got) == set(lang)
    agree = 0
    for d, t in docs:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and r.lang_pred in {*share, "und"}
        words = (t or "").lower().split()
        votes = Counter({y: sum(np.log((share[y][w] + 0.01) / (sum(share[y].values()) + 1)) for w in words) for y in share})
        agree += r.lang_pred == votes.most_common(1)[0][0] or r.lang_pred == "und"
    assert agree >= 0.98 * len(docs)


def test_toxicity_query_takes_every_row(spark, docs):
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, TINY).collect()}
    assert set(got) == {d for d, _ in docs}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    texts = defaultdict(set)
    for d, t in docs:
        texts[t].add(got[d].score)
    assert all(len(s) == 1 for s in texts.values())
