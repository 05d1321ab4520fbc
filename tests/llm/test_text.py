import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, langid, quality, queries, toxicity
from shelfmark.llm.common import fold_of

from .conftest import ODD

TINY = "/root/testdata/sf0.001"


def test_fold_is_crc_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", fold_of("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_language_is_found_on_held_out_documents(spark):
    got = queries.op1_language_id(spark, TINY).join(spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    assert r.a > 0.95


def test_long_texts_are_decided_by_all_their_words():
    """A prior that outweighs twenty words does not outweigh a hundred; the score stays a probability."""
    model = langid.Model(["a", "b"], [np.log(0.999999), np.log(0.000001)], {"x": 0}, {}, np.array([[np.log(0.4), np.log(0.6)]]))
    score = langid.scorer(model)
    assert score("x " * 20)[0] == "a" and score("x " * 100)[0] == "b"
    assert 0 <= score("x " * 100)[1] <= 1


def test_rare_words_and_many_words_are_kept_by_their_counts(spark):
    """More words than any fixed number of entries for a language would hold: each that occurs often enough is known."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    train = spark.createDataFrame([(k, " ".join(words) + f" once{chr(97 + k)}", "xx") for k in range(5)] + [(9, "other text", "yy")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert set(words) <= set(model.words) and not any(w.startswith("once") for w in model.words)


def test_language_backs_off_and_takes_odd_rows(spark, odd, nothing):
    train = spark.createDataFrame([(i, "the thing and the other", "en") for i in range(5)] + [(9 + i, "der dunkle und der andere", "de") for i in range(5)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert "thing" in model.words and "things" not in model.words
    score = langid.scorer(model)
    assert score("things")[0] == "en" and score("dunkler")[0] == "de"
    assert score(None) == score("") == score("123 !?") == ("und", 0.0)
    got = langid.predict(odd, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ODD)
    assert all((r.lang_pred == "und") == (r.score == 0.0) for r in got)
    assert langid.accepted(odd, model).columns == odd.columns
    assert langid.accepted(odd, model).count() == sum(bool(t and t.strip()) for _, t in ODD)
    assert langid.predict(nothing, langid.fit(train.limit(0))).count() == 0
    assert langid.predict(odd, langid.fit(train.limit(0))).where("lang_pred <> 'und'").count() == 0


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c >= "\x80" or c.isdigit() or c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_contamination(rows, items):
    for doc_id, text in rows:
        w = plain_words(text)
        hit, own = set(), set()
        for item, t in items:
            p = plain_words(t)
            size = min(13, len(p))
            for k in range(len(p) - size + 1 if size else 0):
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == p[k : k + size]:
                        hit.update(range(i, i + size))
                        own.add("" if item is None else str(item))
        yield doc_id, len(w), len(hit), tuple(sorted(own)), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_contamination_is_that_of_brute_force(spark, odd, nothing, block):
    rng = np.random.default_rng(4)
    words = [f"v{k}" for k in range(6)]
    rows = [(100 + i, " ".join(rng.choice(words, rng.integers(0, 120)))) for i in range(60)]
    passage = " ".join(rng.choice(words, 20))
    rows += [(200 + i, f"start {passage} end " + "other " * i) for i in range(5)] + [(300, passage)] * 2
    rows += [(d, t) for d, t in ODD if not t or len(t) < 999]
    items = [(1, passage), (2, "Alpha, beta"), (3, None), (4, "..."), (None, "same ROW"), (5, " ".join(rng.choice(words, 14))), (6, "v1 v1 v2"), (6, "v1 v1 v2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench, block_words=block)
    got = found.select("doc_id", "_n_words", decontaminate.n_hit().alias("h"), "_items", decontaminate.contaminated().alias("c")).collect()
    assert Counter((r.doc_id, r._n_words, r.h, tuple(r._items), r.c) for r in got) == Counter(brute_contamination(rows, items))
    left = decontaminate.clean(odd, bench)
    assert left.columns == odd.columns and left.where("_spans IS NULL").count() == 0
    assert decontaminate.clean(nothing, bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == len(ODD)


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(6)
    for n in (1, 2, 50, 300):
        for top in (1, 2, 5):
            text = np.append(rng.integers(1, top + 1, n), 0)
            want = sorted(range(n + 1), key=lambda i: text[i:].tolist())
            assert decontaminate.suffix_array(text).tolist() == want
            tree = decontaminate.WaveletTree(text, 3)
            at = np.arange(n + 1)
            symbol, rank = tree.access(at)
            assert symbol.tolist() == text.tolist()
            assert rank.tolist() == [int((text[:i] == text[i]).sum()) for i in at]
            assert tree.rank(np.full(n + 1, top), at).tolist() == [int((text[:i] == top).sum()) for i in at]


def test_toxicity_grammar_paths():
    I, H, T, N, R, O = (toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.OTHER)  # noqa: E741
    paths = lambda *s: toxicity.clause_paths(list(s), [2.0] * len(s))
    assert paths(O, I) == {"plain": 2.0}
    assert paths(T, O, I) == {"targeted": 2.0}
    assert paths(T, N, O, I) == {"negated": 2.0}
    assert paths(N, O, O, O, I) == {"plain": 2.0}
    assert paths(R, O, O, O, O, I) == {"reported": 2.0}
    assert paths(H, O, T) == {"threat": 1.0}
    assert paths(H, O, O, O, O, T) == {}


def test_toxicity_learns_words_and_beginnings(spark, odd, nothing):
    rng = np.random.default_rng(7)
    common = [f"wort{chr(97 + k)}" for k in range(26)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(common, 30))
        if i % 4 == 0:
            words[5] = "grub" + "abcdefghijklmnop"[i % 16]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert "grub*" in model.lexicon
    got = toxicity.score(docs, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got)
    assert {r.doc_id for r in toxicity.score(odd, model).where("score >= 0.5").collect()} == set()
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).where("score <> 0").count() == 0


def test_quality_shrinks_sparse_sites(spark, odd, nothing):
    rows = [(i, "good text here.", "big.example", "a") for i in range(400)] + [(1000 + i, "good text here.", "bad.example", "a") for i in range(100)]
    rows += [(5000, "good text here.", "bad.example", "b"), (6000, "good text here.", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    marks = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in rows[:500]] + [(None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, marks)
    got = {r.doc_id: r for r in quality.posteriors(quality.evidence(docs, model), marks).collect()}
    assert len(got) == len(rows)
    # The text says nothing, so the site decides: a sparse path follows its host, an unknown site the whole.
    assert got[1000].score < got[5000].score < got[6000].score < got[0].score
    assert 0 <= min(r.score for r in got.values()) and max(r.score for r in got.values()) <= 1
    sites = odd.withColumns({"host": F.lit("h"), "path": F.lit(None).cast("string")})
    pages = spark.createDataFrame([(1, "http://www.x.example/en/5.html?a=1", ""), (2, None, ""), (3, "https://y.example/", "")], "page_id long, url string, html string")
    placed = quality.with_sites(quality.evidence(sites, model), pages)
    assert placed.count() == len(ODD) and placed.where("host = 'www.x.example' AND path = 'en'").count() == 1
    assert quality.posteriors(placed, marks).count() == len(ODD)
    assert quality.posteriors(quality.evidence(sites.limit(0), quality.fit(docs, marks.limit(0))), marks).count() == 0
