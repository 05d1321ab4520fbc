"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths).  Pieces go
in by falling length; among the sequences that have room under every capacity, ``rule`` selects one:
``norm`` the least weighted norm of what would remain, ``dot`` the largest weighted dot product of the piece
and what remains.

Pieces of one length are alike, so the choice is made on counts: the driver sees the number of pieces of each
length (at most as many rows as a sequence has tokens, whatever the input) and plans groups of like sequences.  Every
piece then finds its place by its number among the pieces of its length: the number in its task, counted
while encoding, plus the count of the tasks before.  No piece, text or id passes through the driver.

Defined cases: NULL text is an empty text, which still has the end id.  Longer documents than a sequence are cut so that
only the first piece is short.  Documents are numbered as they come, so NULL and repeated ids are packed like
others; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import small_batches, written
from shelfmark.llm.tokens import encoder


#: Of tokens, documents and attention cost.
WEIGHTS = (1.0, 0.5, 0.5)


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int | None = None  # None: as many as there are tokens
    attention: int | None = None  # None: the square of tokens

    def vector(self) -> np.ndarray:
        v = np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)
        if v.min() < 1:
            raise ValueError("capacities must be positive")
        return v

    def longest(self) -> int:
        """The longest piece that fits an empty sequence."""
        return int(min(self.tokens, math.isqrt(self.attention) if self.attention else self.tokens))


@dataclass
class Plan:
    """Where the pieces of each length go: sorted by (length, first number)."""

    key: np.ndarray  # length << 44 | first number
    sequence: np.ndarray  # sequence of the first number; the next numbers take the next sequences
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = (length << 44) | number
        at = np.searchsorted(self.key, wanted, "right") - 1
        return self.sequence[at] + wanted - self.key[at], self.offset[at]


def plan(counts: dict[int, int], capacity: Capacity, rule: str = "norm", weights=(1.0, 1e-6, 1e-6)) -> Plan:
    """Best fit over groups of like sequences.  A length changes most groups as a whole and splits few,
    so their number stays near a small multiple of the number of lengths."""
    full = capacity.vector()
    w = np.array(weights) / full.astype(float)
    rest = np.empty((0, 3), np.int64)  # what remains, of each open group
    many = np.empty(0, np.int64)
    inside: list[tuple] = []  # ((length, times), earlier) from the last to the first
    done: list[tuple[int, tuple]] = []
    for length in sorted(counts, reverse=True):
        left, item = counts[length], np.array([length, 1, length * length], np.int64)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens doesn't fit an empty sequence")
        while left:
            fits = np.flatnonzero((rest >= item).all(axis=1))
            if len(fits):
                if rule == "norm":
                    g = int(fits[np.argmin((((rest[fits] - item) * w) ** 2).sum(axis=1))])
                else:
                    g = int(fits[np.argmax((rest[fits] * w * (item * w)).sum(axis=1))])
                room, available, before = rest[g], int(many[g]), inside[g]
            else:
                g, room, available, before = None, full, left, None
            # By norm, a sequence that took a piece is the best fit for the next one too; so is a new one by any rule.
            times = min(left, int((room // item).min())) if rule == "norm" or g is None else 1
            bins = min(available, left // times)
            if g is not None:
                many[g] -= bins
            rest = np.vstack([rest, room - item * times])
            many = np.append(many, bins)
            inside.append(((length, times), before))
            left -= bins * times
            if g is not None and not many[g]:
                rest, many = np.delete(rest, g, axis=0), np.delete(many, g)
                inside.pop(g)
        shut = (rest[:, 0] < 1) | (rest[:, 1] < 1) | (rest[:, 2] < 1)
        if shut.any():
            done += [(int(many[i]), inside[i]) for i in np.flatnonzero(shut)]
            rest, many, inside = rest[~shut], many[~shut], [x for x, s in zip(inside, shut) if not s]
    done += [(int(m), x) for m, x in zip(many, inside)]
    keys, sequence, offset, numbered, base = [], [], [], dict.fromkeys(counts, 0), 0
    for bins, runs in done:
        chain = []
        while runs:
            chain.append(runs[0])
            runs = runs[1]
        at = 0
        for length, times in reversed(chain):
            for _ in range(times):
                keys.append(length << 44 | numbered[length])
                sequence.append(base)
                offset.append(at)
                numbered[length] += bins
                at += length
        base += bins
    by = np.argsort(np.array(keys, np.int64))
    return Plan(*(np.array(x, np.int64)[by] for x in (keys, sequence, offset)), base)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, longest: int, keep_ids: bool = False) -> DataFrame:
    """Encode and cut; with the task that made the piece and its number among that task's pieces of its length."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        task, numbered = TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        for b in batches:
            rows = []
            for at, text in enumerate(b["text"].to_pylist()):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                first = (n - 1) % longest + 1
                for p, stop in enumerate(range(first, n + 1, longest)):
                    start = 0 if p == 0 else stop - longest
                    cut = ids[4 * start : 4 * stop]
                    rows.append((at, p, start, stop - start, zlib.crc32(cut), numbered[stop - start]) + (np.frombuffer(cut, "<u4").astype(np.int32),) * keep_ids)
                    numbered[stop - start] += 1
            at, p, start, length, crc, number, *ids = zip(*rows) if rows else [[]] * (6 + keep_ids)
            arrays = [b["doc_id"].take(pa.array(at, pa.int64())), pa.array(p, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(at), pa.int32()), pa.array(number, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(x, pa.list_(pa.int32())) for x in ids], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids array<int>" * keep_ids
    )


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: Capacity = Capacity(), rule: str = "norm",
    weights=WEIGHTS, keep_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of ``docs``.  By default what remains
    of all three capacities selects the sequence, tokens first: beside a fit in tokens, sequences of many and of few pieces stay alike."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, end_id, capacity.longest(), keep_ids), "pieces")
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shipped = spark.sparkContext.broadcast(plan(counts, capacity, rule, weights))
    ahead = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    placed = cut.join(per_task.select("task", "length", F.coalesce(ahead, F.lit(0)).alias("ahead")), ["task", "length"])
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = {f.name: f.dataType.simpleString() for f in cut.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b["number"].to_numpy() + b["ahead"].to_numpy()
            sequence, offset = shipped.value.place(b["length"].to_numpy(), number)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return placed.select(*kept, "number", "ahead").mapInArrow(
        run, ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and the piece lengths in order, of what ``pack(keep_ids=True)`` returns; a sequence has
    no more pieces than tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["length"]).alias("lengths"),
    )
