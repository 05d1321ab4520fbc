"""Benchmark decontamination with an FM-index per shard of training text.

The test phrases are the windows of 13 words of every benchmark item (the whole item if it is shorter).
Each task gathers its documents into shards of at most ``SHARD_WORDS`` words, builds an FM-index of the
shard (suffix array, Burrows-Wheeler transform, wavelet tree with rank counts, every 16th text position
sampled), searches all phrases backwards at once and locates the hits by walking to sampled positions.
The located spans are merged per document.

The index alphabet is the vocabulary of the phrases.  A stretch of other words ends a segment, and a segment
shorter than the shortest phrase can't hold an occurrence, so neither is indexed; this loses nothing.
Phrases are broadcast in blocks of at most ``BLOCK_WORDS`` benchmark words; a larger benchmark takes one
pass for each block, which adds its spans to those of the blocks before.  The result of each pass but the last is
written and its phrases are released before the next, so tasks hold one block, and the driver one block and the next
with one partition of the benchmark.

Defined cases: NULL or wordless texts have no words and no hits; so has everything when the benchmark is
empty.  An item without words is no phrase.  Items that share a window all count.  A NULL item_id takes part in
the hits and is written as an empty string.  Documents are judged row by row, so NULL or repeated ids and
extra columns need no care.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import guarded, small_batches, written

WINDOW = 13
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 21
SAMPLED = 16

#: ASCII: A-Z to a-z, digits and letters kept, all else to a space.  Bytes of other characters are kept.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WaveletTree:
    """Ranks of symbols below ``2**levels``, one stably partitioned bit row for each level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.zeros, self.ones = levels, [], []
        now = symbols
        for level in range(levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(upto)
        end = upto
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            s, e = self.ones[k][start], self.ones[k][end]
            start, end = np.where(one, self.zeros[k] + s, start - s), np.where(one, self.zeros[k] + e, end - e)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol = np.zeros_like(at)
        start, here = np.zeros_like(at), at
        for k in range(self.levels):
            s, h = self.ones[k][start], self.ones[k][here]
            one = self.ones[k][here + 1] > h
            symbol = symbol * 2 + one
            start, here = np.where(one, self.zeros[k] + s, start - s), np.where(one, self.zeros[k] + h, here - h)
        return symbol, here - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))  # a group's rank is its first place
    tied = _tied(order, rank)
    step = 1
    while len(tied):
        rows = order[tied]
        nxt = rows + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        head = rank[rows]
        by = np.lexsort((second, head))
        rows, second, head = rows[by], second[by], head[by]
        order[tied] = rows
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (second[1:] != second[:-1])])
        start = np.maximum.accumulate(np.where(new, tied, 0))
        rank[rows] = start
        single = new & np.append(new[1:], True)
        tied = tied[~single]
        step *= 2
    return order


def _tied(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    r = rank[order]
    same = np.concatenate([[False], r[1:] == r[:-1]])
    return np.flatnonzero(same | np.append(same[1:], False))


class FMIndex:
    """Of ``text``, whose symbols are 1 and up; 0 is kept for the end of the text."""

    def __init__(self, text: np.ndarray, alphabet: int):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.tree = WaveletTree(bwt, max(1, int(alphabet).bit_length()))
        marked = order % SAMPLED == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases of one length; the range of suffixes that begin with each."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back until a sampled one."""
        at, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            found = self.marks[here + 1] > self.marks[here]
            out[live[found]] = self.samples[self.marks[here[found]]] + steps
            live = live[~found]
            symbol, rank = self.tree.access(at[live])
            at[live] = self.before[symbol] + rank
            steps += 1
        return out


@dataclass
class Phrases:
    vocabulary: dict[bytes, int]
    windows: dict[int, np.ndarray]  # by length: one row of symbols for each distinct window
    owners: dict[int, list[list[str]]]  # by length: ids of the items that have the window
    shortest: int


def phrases_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item_id, text in items:
        w = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in words_of(text)]
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(w[i : i + size]), set()).add(item_id)
    return Phrases(
        vocabulary,
        {k: np.array(list(v), np.int64) for k, v in found.items()},
        {k: [sorted(x) for x in v.values()] for k, v in found.items()},
        min(found, default=0),
    )


def occurrences(shard: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document in the shard, first word, length, window) of every occurrence in symbol arrays, in
    which 0 is any word outside the vocabulary.  In the index 1 ends a segment and words follow from 2."""
    parts, docs, places = [], [], []
    for d, symbols in enumerate(shard):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (symbols > 0).view(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        for s, e in zip(starts, ends):
            if e - s >= phrases.shortest:
                parts += [symbols[s:e] + 1, np.ones(1, np.int64)]
                docs.append(np.full(e - s + 1, d))
                places.append(np.arange(s, e + 1))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    doc, place = np.concatenate(docs), np.concatenate(places)
    index = FMIndex(np.concatenate(parts), len(phrases.vocabulary) + 1)
    out = []
    for length, rows in phrases.windows.items():
        low, high = index.search(rows + 1)
        n = np.maximum(high - low, 0)
        hit = np.flatnonzero(n)
        each = np.repeat(hit, n[hit])
        suffix = np.arange(len(each)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit]) + low[each]
        at = index.locate(suffix)
        out.append((doc[at], place[at], np.full(len(at), length), each))
    return tuple(np.concatenate(x) for x in zip(*out))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, str | None]]]:
    block, size, seen = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        block.append((r["item_id"] or "", r["text"]))
        size += len(words_of(r["text"]))
        if size >= most:
            yield block
            block, size, seen = [], 0, True
    if block or not seen:
        yield block


_TYPES = {"_spans": pa.list_(pa.list_(pa.int64())), "_items": pa.list_(pa.string())}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, spans (merged [first, end) word ranges to remove) and items (sorted ids of
    items found) as columns ``_n_words``, ``_spans`` and ``_items`` (replacing any of these names); all others are kept."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.withColumns({
        "_n_words": F.lit(0).cast("long"),
        "_spans": F.array().cast("array<array<bigint>>"),
        "_items": F.array().cast("array<string>"),
    })
    blocks = _blocks(benchmark, block_words)
    block = next(blocks)
    while block is not None:
        shipped = spark.sparkContext.broadcast(phrases_of(block, window))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            phrases = shipped.value
            held, size = [], 0
            for b in batches:
                symbols, n = [], []
                for text in b["text"].to_pylist():
                    w = words_of(text)
                    n.append(len(w))
                    symbols.append(np.fromiter(map(phrases.vocabulary.get, w, [0] * len(w)), np.int64, len(w)))
                held.append((b, symbols, n))
                size += sum(n)
                if size >= SHARD_WORDS:
                    yield from _judged(held, phrases)
                    held, size = [], 0
            yield from _judged(held, phrases)

        out = out.mapInArrow(run, out.schema)
        block = next(blocks, None)
        if block is not None:
            out = written(out, "decontaminate-block")
            shipped.destroy()
    return out


def _judged(held: list, phrases: Phrases) -> Iterator[pa.RecordBatch]:
    doc, start, length, window = occurrences([s for _, symbols, _ in held for s in symbols], phrases)
    by = np.argsort(doc, kind="stable")
    doc, start, length, window = doc[by], start[by], length[by], window[by]
    cuts = np.searchsorted(doc, np.arange(sum(len(n) for *_, n in held) + 1))
    at = 0
    for b, _, n in held:
        spans, items = b["_spans"].to_pylist(), b["_items"].to_pylist()
        for i in range(len(n)):
            lo, hi = cuts[at + i], cuts[at + i + 1]
            if hi > lo:
                s, size = start[lo:hi], length[lo:hi]
                old = np.array(spans[i], np.int64).reshape(-1, 2)
                spans[i] = merged(np.concatenate([old[:, 0], s]), np.concatenate([old[:, 1], s + size]))
                own = {x for k, w in set(zip(size.tolist(), window[lo:hi].tolist())) for x in phrases.owners[k][w]}
                items[i] = sorted(own.union(items[i]))
        at += len(n)
        new = {"_n_words": pa.array(n, pa.int64()), "_spans": pa.array(spans, _TYPES["_spans"]), "_items": pa.array(items, _TYPES["_items"])}
        yield pa.RecordBatch.from_arrays([new.get(c, b[c]) for c in b.schema.names], b.schema.names)


def n_hit() -> Column:
    return F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])


def contaminated() -> Column:
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("_n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, that are not contaminated."""
    return guarded(docs, ["_n_words", "_spans", "_items"], lambda d: contamination(d, benchmark).where(~contaminated()))
