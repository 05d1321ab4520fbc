"""Ranked lexical search over a length-stratified inverted index.

``index`` turns every document into postings.  Tasks gather their documents into segments of at most ``SEGMENT_DOCS``
documents or about ``SEGMENT_WORDS`` words (a longer document is one alone) and write one row for each segment and term: its
postings ordered by document length and, within one length, by falling tf.  A further row of each segment holds its documents.
Documents of one normaliser m are a stratum; m grows with the length, so the strata of a posting list are consecutive runs, whatever m
the statistics of the whole corpus then give.

``search`` takes the queries in blocks of at most ``BLOCK_TERMS`` terms.  Of each segment it reads the rows of these terms.
The impact of a (stratum, tf) pair is computed once.  The bound of a stratum for a query is the sum of each term's weight times the
greatest impact that the term has there; strata are visited by falling bound, the first few alone, then all that can
still reach the k-th best score, and none once no bound does.  The scores are whole numbers, so the bounds are exact.

A document's m is 10 + (90 n N) div L, an impact (10^9 tf) div (1000 tf + 8 m), a weight floor(1000 ln((2N + 2) / (2 df + 1))).
Terms are maximal runs of ASCII letters and digits and all other characters beyond ASCII; A-Z count as a-z.

Defined cases: a NULL or wordless text has no terms, is not counted in N and is never found.  Queries without terms, and all
queries of an empty corpus, have no rows.  Equal scores come by ascending doc_id (NULL last), equal rows too; repeated
document rows are documents of their own, repeated (item_id, text) rows are one query.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import small_batches, written
from shelfmark.llm.decontaminate import words_of

SEGMENT_DOCS = 1 << 13
SEGMENT_WORDS = 1 << 21
BLOCK_TERMS = 1 << 17
FIRST_STRATA = 4
NO_ID = np.iinfo(np.int64).max

#: term NULL: the segment's documents, ``doc_ids`` and ``lengths`` of each; else the postings of a term in the order of (length, -tf).
SCHEMA = "segment string, term binary, df int, docs binary, tfs binary, ids binary, lengths binary"
_FIELDS = pa.schema([("segment", pa.string()), ("term", pa.binary()), ("df", pa.int32())] + [(c, pa.binary()) for c in ("docs", "tfs", "ids", "lengths")])


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _segment(name: str, ids: list[int | None], symbols: list[np.ndarray], vocabulary: _Vocabulary) -> Iterator[pa.RecordBatch]:
    """Documents in the order of their length, so that a document's place also orders its stratum."""
    lengths = np.array([len(s) for s in symbols], np.int64)
    by = np.argsort(lengths, kind="stable")
    lengths = lengths[by]
    doc = np.repeat(np.arange(len(by)), lengths)
    term = np.concatenate([symbols[i] for i in by]) if len(by) else np.empty(0, np.int64)
    pair, tf = np.unique(term * len(by) + doc, return_counts=True)
    term, doc = np.divmod(pair, max(len(by), 1))
    order = np.lexsort((doc, -tf, lengths[doc], term))
    term, doc, tf = term[order], doc[order].astype(np.uint32), tf[order].astype(np.uint32)
    starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    row_ids = np.array([NO_ID if ids[i] is None else ids[i] for i in by], np.int64)
    none = [None]
    yield pa.RecordBatch.from_pydict({
        "segment": [name], "term": none, "df": [len(by)], "docs": none, "tfs": none, "ids": [row_ids.tobytes()], "lengths": [lengths.tobytes()]
    }, _FIELDS)
    words = list(vocabulary)
    for lo in range(0, len(words), 4096):
        hi = min(lo + 4096, len(words))
        cut = [slice(starts[i], starts[i + 1]) for i in range(lo, hi)]
        gap = [None] * (hi - lo)
        yield pa.RecordBatch.from_pydict({
            "segment": [name] * (hi - lo), "term": words[lo:hi], "df": [c.stop - c.start for c in cut],
            "docs": [doc[c].tobytes() for c in cut], "tfs": [tf[c].tobytes() for c in cut], "ids": gap, "lengths": gap,
        }, _FIELDS)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, k = TaskContext.get().partitionId(), 0
    ids, symbols, size, vocabulary = [], [], 0, _Vocabulary()
    for b in batches:
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            words = words_of(text)
            if not words:
                continue
            if ids and size + len(words) > SEGMENT_WORDS or len(ids) == SEGMENT_DOCS:
                yield from _segment(f"{task}-{k}", ids, symbols, vocabulary)
                ids, symbols, size, vocabulary, k = [], [], 0, _Vocabulary(), k + 1
            ids.append(doc_id)
            symbols.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
            size += len(words)
    if ids:
        yield from _segment(f"{task}-{k}", ids, symbols, vocabulary)


def index(docs: DataFrame) -> DataFrame:
    """The index of every row of ``docs`` as a table in the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_indexed, SCHEMA), "lexical-index")


def statistics(indexed: DataFrame) -> tuple[int, int]:
    """N and L."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for x in b["lengths"].to_pylist():
                lengths = np.frombuffer(x, np.int64)
                n, total = n + len(lengths), total + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    row = indexed.where("term IS NULL").select("lengths").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def normaliser(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    return 10 + 90 * lengths * n // max(total, 1)


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Queries as (item_id, distinct terms), read partition by partition."""
    block, size = [], 0
    for r in items.select("item_id", F.col("text").cast("string").alias("text")).distinct().toLocalIterator():
        terms = list(dict.fromkeys(words_of(r["text"])))
        if terms:
            block.append((r["item_id"], terms))
            size += len(terms)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


class Best:
    """The k highest-scoring documents of each query so far, by (-score, doc_id)."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(queries)]

    def least(self, q: int) -> int:
        """No lower score enters; an equal one may, by its doc_id."""
        return -self.rows[q][-1][0] if len(self.rows[q]) == self.k else 1

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = np.flatnonzero(scores >= self.least(q))
        if len(ok) > self.k:
            ok = ok[np.lexsort((ids[ok], -scores[ok]))[: self.k]]
        self.rows[q] = sorted([*self.rows[q], *zip((-scores[ok]).tolist(), ids[ok].tolist())])[: self.k]


def _search_segment(m: np.ndarray, ids: np.ndarray, postings: dict[bytes, tuple[np.ndarray, np.ndarray]], queries: list[tuple[list[bytes], list[int]]], best: Best) -> None:
    """``m`` by document, never falling; ``postings``: documents and their tf by term."""
    stratum = np.cumsum(np.concatenate([[0], np.diff(m) > 0]))
    value = m[np.concatenate([[True], np.diff(m) > 0])]
    #: Each (stratum, tf) pair gets its impact once.
    names = list(postings)
    sizes = [len(postings[t][0]) for t in names]
    doc = np.concatenate([postings[t][0] for t in names]).astype(np.int64)
    tf = np.concatenate([postings[t][1] for t in names]).astype(np.int64)
    at = stratum[doc]
    pairs, which = np.unique(at << 32 | tf, return_inverse=True)
    tf_of = pairs & 0xFFFFFFFF
    impact = (1_000_000_000 * tf_of // (1000 * tf_of + 8 * value[pairs >> 32]))[which]
    ends = np.cumsum(sizes)
    places = {t: slice(e - s, e) for t, s, e in zip(names, sizes, ends)}
    #: Runs of one stratum in a posting list: the first has the greatest tf of its length; several lengths may share m.
    top: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
    for t, c in places.items():
        own = at[c]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        top[t] = own[first], np.maximum.reduceat(impact[c], first)
    for q, (terms, weights) in enumerate(queries):
        held = [(t, w) for t, w in zip(terms, weights) if t in places and w]
        if not held:
            continue
        bound = np.zeros(len(value), np.int64)
        for t, w in held:
            strata, most = top[t]
            bound[strata] += w * most
        order = np.argsort(-bound, kind="stable")
        done = np.zeros(len(value), bool)
        for visit in (order[:FIRST_STRATA], order[FIRST_STRATA:]):
            visit = visit[bound[visit] >= best.least(q)]
            if not len(visit):
                break
            done[:] = False
            done[visit] = True
            scores = np.zeros(len(m), np.int64)
            for t, w in held:
                c = places[t]
                d, x = doc[c], impact[c]
                if len(visit) < len(value):
                    keep = done[at[c]]
                    d, x = d[keep], x[keep]
                scores[d] += w * x  # a document is once in a posting list
            found = np.flatnonzero(scores)
            best.add(q, scores[found], ids[found])


def search(indexed: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item with a score above 0."""
    spark = indexed.sparkSession
    small_batches(spark)
    n, total = statistics(indexed)
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    blocks = _blocks(items, block_terms)
    block = next(blocks, None)
    while block is not None:
        vocabulary = spark.createDataFrame([(bytearray(t),) for t in {t for _, terms in block for t in terms}], "term binary")
        rows = indexed.where("term IS NOT NULL").join(F.broadcast(vocabulary), "term")
        df = {bytes(r["term"]): r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
        queries = [(terms, [weight(df[t], n) if t in df else 0 for t in terms]) for _, terms in block]
        shipped = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            best, now, m, ids, postings = Best(len(shipped.value), k), None, None, None, {}
            for b in batches:
                for row in b.to_pylist():
                    if row["segment"] != now:
                        if postings:
                            _search_segment(m, ids, postings, shipped.value, best)
                        now, postings = row["segment"], {}
                    if row["term"] is None:
                        ids = np.frombuffer(row["ids"], np.int64)
                        m = normaliser(np.frombuffer(row["lengths"], np.int64), n, total)
                    else:
                        postings[row["term"]] = np.frombuffer(row["docs"], np.uint32), np.frombuffer(row["tfs"], np.uint32)
            if postings:
                _search_segment(m, ids, postings, shipped.value, best)
            q = [i for i, x in enumerate(best.rows) for _ in x]
            flat = [x for rows in best.rows for x in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array(q, pa.int32()), pa.array([d for _, d in flat], pa.int64()), pa.array([-s for s, _ in flat], pa.int64())
            ], ["_q", "_doc", "score"])

        parts = rows.unionByName(indexed.where("term IS NULL")).repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())
        found = parts.mapInArrow(run, "_q int, _doc long, score long")
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), "_doc"))).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"_q int, item_id {kind}"))
        part = ranked.join(names, "_q").select("item_id", "rank", F.nullif("_doc", F.lit(NO_ID)).alias("doc_id"), "score")
        block = next(blocks, None)
        if block is None:
            return out.unionByName(part)
        out = out.unionByName(written(part, "lexical-block"))
        shipped.destroy()
    return out
