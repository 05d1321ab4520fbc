"""Language identification by word-first backoff.

A word that the training text knows is scored by its log frequency in each language.  An unseen
word is cut into character n-grams instead: at each place the longest known n-gram is taken, so
that the score falls back from 5 to 4, 3, 2 and 1 characters.  The sums, with the log share of each
language, give the posterior.

Learning counts words and n-grams by grouped aggregation over at most ``sample`` documents of each
language (a documented bound of the classifier's training rows, chosen by a hash of doc_id).  The model keeps
the words and n-grams that occur at least ``least`` times in a language; the bounded sample bounds their number.
All words of a text decide its language; the score flattens the posterior of long texts (``FULL_EVIDENCE``), in which no word is independent
of those before.

Defined cases: NULL text or a text without a letter gives ``und`` and score 0; so does every text when
nothing could be learned.  Equal posteriors go to the language that sorts first.  Rows are scored one
by one, so repeated rows, NULL ids, empty tables and extra columns need no care.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import fold_of, share_of, small_batches

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Words of evidence beyond which the score is not sharpened further; the decision takes all words.
FULL_EVIDENCE = 20
CACHE = 200_000
MAX_LANGUAGES = 256


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    prior: list[float]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def backoff(self, word: str) -> np.ndarray:
        """Longest known n-gram at each place, from left to right."""
        marked, at = f"^{word}$", 0
        total = np.zeros(len(self.languages))
        while at < len(marked):
            for n in range(min(LONGEST, len(marked) - at), 0, -1):
                row = self.grams.get(marked[at : at + n])
                if row is not None:
                    total = total + self.table[row]
                    break
            at += n
        return total

    def word_score(self, word: str) -> np.ndarray:
        row = self.words.get(word)
        return self.table[row] if row is not None else self.backoff(word)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: dict[str, Counter] = {}
        for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist()):
            found.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["lang", "word", "n"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: Counter = Counter()
        for lang, word, n in zip(b["lang"].to_pylist(), b["word"].to_pylist(), b["n"].to_pylist()):
            for size in range(1, LONGEST + 1):
                for g in grams_of(word, size):
                    found[lang, size, g] += n
        if found:
            rows = [(*k, n) for k, n in found.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                ["lang", "size", "gram", "n"],
            )


def fit(train: DataFrame, sample: int = 4000, least: int = 5) -> Model:
    """``train``: doc_id, text, lang.  Rows without lang are not learned from."""
    small_batches(train.sparkSession)
    known = train.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], [])
    quota = F.create_map(*[F.lit(x) for k in languages for x in (k, sample / counts[k])])
    chosen = known.where(share_of(F.col("doc_id")) < quota[F.col("lang")]).select("text", "lang")
    words = chosen.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = words.mapInArrow(_grams, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    often = F.col("n") >= least
    tables = [
        words.where(often).select("lang", F.lit(0).alias("size"), F.col("word").alias("token"), "n"),
        grams.where(often).select("lang", "size", F.col("gram").alias("token"), "n"),
    ]
    rows = tables[0].unionByName(tables[1]).collect()
    total: Counter = Counter()
    seen: dict[tuple[int, str], dict[str, int]] = {}
    for r in rows:
        total[r["lang"], r["size"]] += r["n"]
        seen.setdefault((r["size"], r["token"]), {})[r["lang"]] = r["n"]
    kinds = Counter(size for size, _ in seen)
    scores = np.empty((len(seen), len(languages)))
    model = Model(languages, [math.log(counts[x] / sum(counts.values())) for x in languages])
    for at, (size, token) in enumerate(sorted(seen)):
        (model.words if size == 0 else model.grams)[token] = at
        by = seen[size, token]
        for k, lang in enumerate(languages):
            scores[at, k] = math.log((by.get(lang, 0) + 0.5) / (total[lang, size] + 0.5 * kinds[size]))
    model.table = scores
    return model


def scorer(model: Model):
    """text -> (language, score), keeping the scores of recent words."""
    cache: dict[str, int] = {}
    store = np.zeros((CACHE, max(1, len(model.languages))))

    class Rows(dict):
        def __missing__(self, word: str) -> int:
            at = len(self)
            store[at] = model.word_score(word)
            self[word] = at
            return at

    cache = Rows()

    def score(text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not model.languages:
            return "und", 0.0
        total = np.zeros(len(model.languages))
        for k in range(0, len(words), CACHE // 2):
            part = words[k : k + CACHE // 2]
            if len(cache) + len(part) > CACHE:
                cache.clear()
            total += store[list(map(cache.__getitem__, part))].sum(axis=0)
        best = int(np.argmax(total + model.prior))
        shown = total * min(1.0, FULL_EVIDENCE / len(words)) + model.prior
        return model.languages[best], float(1 / np.exp(shown - shown[best]).sum())

    return score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, lang_pred, score for every row."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shipped.value)
        for b in batches:
            got = [score(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose language is found (not ``und``) and scored at least ``least``."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shipped.value)
        for b in batches:
            got = [score(t) for t in b["text"].to_pylist()]
            yield b.filter(pa.array([x != "und" and s >= least for x, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The four fifths of ``docs`` that may be learned from."""
    return docs.where(fold_of("doc_id") != 0).select("doc_id", "text", "lang")
