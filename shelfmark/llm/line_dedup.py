"""Line deduplication with two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased.  Each task puts the keys
of its documents (a key once for each document) into a filter of keys seen once and, when they were there
already, into one of keys seen twice; merged over all tasks, the second holds every key of two or more
documents.  Only lines that it suspects are shuffled, counted per batch first, to find exactly the keys
that ``min_docs`` documents have.

A filter has at most ``most_bits`` bits.  More lines than that serves are dealt by their 8-byte hashes to ranges, each with
a pair of filters of its own in the task that owns it; what the owners have seen twice makes the filter that suspects
lines, and if it must be larger than ``most_bits`` too, the documents are read once for each range of it.  So
the share of lines that are suspected by mistake is the same at any size.  Those lose all their lines (``keep="none"``), or all but the first of the
first document (``keep="first"``: the smallest doc_id, then the smallest text hash).

The keys to drop are broadcast if their text is at most ``broadcast_bytes``; beyond that the suspected lines
are joined with them and the answer is joined to the documents.  Both ways give the same rows.

Defined cases: NULL and empty texts are one empty line and stay as they are.  Empty keys are
never dropped.  A row is a document: repeated rows and repeated or NULL ids count as documents of their own.  All
columns are kept, whatever their names; only ``text`` changes.  With ``keep="first"``, of rows that
repeat the first document's id and text each keeps its line, as nothing tells them apart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import bloom
from shelfmark.llm.common import small_batches, written

WHITE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BROADCAST_BYTES = 32 << 20


def keys_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys."""
    lines = (text or "").encode().split(b"\n")
    return lines, [line.translate(_LOWER).strip(WHITE) for line in lines]


def hashes_of(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64)


def suspected(text: str | None, twice: np.ndarray) -> list[bytes]:
    """The distinct keys of a text that the filter may hold."""
    keys = sorted({k for k in keys_of(text)[1] if k})
    return [k for k, hit in zip(keys, bloom.within(twice, hashes_of(keys))) if hit] if keys else []


def _distinct_hashes(b: pa.RecordBatch) -> np.ndarray:
    """The hashes of a batch's keys, each once for each document."""
    return hashes_of(k for t in b["text"].to_pylist() for k in {*keys_of(t)[1]} if k)


@dataclass
class Suspects:
    """Keys whose hash is in range ``part`` of ``parts`` and in the filter."""

    twice: np.ndarray
    part: int = 0
    parts: int = 1

    def of(self, text: str | None) -> list[bytes]:
        if self.parts == 1:
            return suspected(text, self.twice)
        keys = sorted({k for k in keys_of(text)[1] if k})
        h = hashes_of(keys)
        return [k for k, hit in zip(keys, (_range(h, self.parts) == self.part) & bloom.within(self.twice, h)) if hit] if keys else []


def _range(hashes: np.ndarray, parts: int) -> np.ndarray:
    """From the upper bits, which the filters use least."""
    return ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _ranges(items: int, most_bits: int) -> int:
    return max(1, -(-12 * items // most_bits))


def _suspects(docs: DataFrame, most_bits: int) -> Iterator[Suspects]:
    """One or more filters that together hold every key of two or more documents."""
    breaks = F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    n = docs.agg(breaks.alias("n")).first()["n"] or 1
    if _ranges(n, most_bits) == 1:
        bits = bloom.bits_for(n)

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = bloom.Pair(bits)
            for b in batches:
                pair.add(_distinct_hashes(b))
            yield from pair.slices()

        yield Suspects(bloom.merged(docs.select("text").mapInArrow(fill, bloom.SCHEMA), bits).twice)
        return
    ranges = _ranges(n, most_bits)
    again = _owned(docs, ranges, bloom.bits_for(n // ranges))
    found = again.count()
    parts = _ranges(found, most_bits)
    for part in range(parts):
        mine = again.where(F.shiftrightunsigned("h", 40) % parts == part) if parts > 1 else again
        bits = bloom.bits_for(max(1, found // parts))

        def put(batches: Iterator[pa.RecordBatch], bits=bits) -> Iterator[pa.RecordBatch]:
            pair = bloom.Pair(bits)
            for b in batches:
                pair.add(b["h"].to_numpy().view(np.uint64))
            yield from pair.slices()

        yield Suspects(bloom.merged(mine.mapInArrow(put, bloom.SCHEMA), bits).once, part, parts)


def _owned(docs: DataFrame, ranges: int, bits: int) -> DataFrame:
    """Hashes (h) that the owners of the ranges have seen twice, as a table.  A batch sends a hash once; ``more`` says that several of
    its documents have the line."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = np.unique(_distinct_hashes(b), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1), pa.array(_range(h, ranges))], ["h", "more", "part"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pair = None, None
        for b in batches:
            hashes, more, at = b["h"].to_numpy().view(np.uint64), b["more"].to_numpy(zero_copy_only=False), b["part"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else []
            for lo, hi in zip(edges, edges[1:]):
                if at[lo] != part:
                    part, pair = at[lo], bloom.Pair(bits)
                h = np.unique(hashes[lo:hi])
                known = bloom.within(pair.twice, h)
                pair.add(np.concatenate([hashes[lo:hi], hashes[lo:hi][more[lo:hi]]]))
                new = h[bloom.within(pair.twice, h) & ~known]
                if len(new):
                    yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64))], ["h"])

    hashes = docs.select("text").mapInArrow(emit, "h long, more boolean, part long")
    tasks = max(ranges, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(hashes.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(own, "h long"), "repeated-hashes")


def deduplicated(
    docs: DataFrame, min_docs: int = 2, keep: str = "first", broadcast_bytes: int = BROADCAST_BYTES, most_bits: int = bloom.MOST_BITS
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and columns ``_n_lines`` and ``_n_dropped`` (replacing
    any of these names, or of ``_drop``)."""
    if min_docs < 2 or keep not in ("first", "none"):
        raise ValueError("min_docs is 2 or more, keep is first or none")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("_n_lines", "_n_dropped", "_drop")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    first = keep == "first"

    def count(batches: Iterator[pa.RecordBatch], suspects) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, least = Counter(), {}
            ids = b["doc_id"].to_pylist() if first else [None] * b.num_rows
            for doc_id, text in zip(ids, b["text"].to_pylist()):
                hit = suspects.value.of(text)
                n.update(hit)
                if first and hit:
                    at = (doc_id is None, doc_id, xxhash.xxh64_intdigest(text) >> 1)
                    for k in hit:
                        if k not in least or at < least[k]:
                            least[k] = at
            who = [least[k][1:] if first else (None, None) for k in n]
            arrays = [pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([x for x, _ in who], b["doc_id"].type), pa.array([x for _, x in who], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "doc_id", "h"])

    owner = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("owner")
    filters, found = [], []
    for suspects in _suspects(docs, most_bits):
        shipped = spark.sparkContext.broadcast(suspects)
        counted = docs.select("doc_id", "text").mapInArrow(partial(count, suspects=shipped), f"key binary, n long, doc_id {id_type}, h long")
        found.append(written(
            counted.groupBy("key").agg(F.sum("n").alias("n"), owner).where(F.col("n") >= min_docs)
            .select("key", F.col("owner.doc_id").alias("doc_id"), F.col("owner.h").alias("h")), "repeated-lines",
        ))
        filters.append(shipped)
        shipped.unpersist()
    repeated = reduce(DataFrame.unionByName, found)
    size = repeated.agg(F.sum(F.octet_length("key") + 24).alias("n")).first()["n"] or 0
    if size <= broadcast_bytes:
        drop = spark.sparkContext.broadcast({bytes(r["key"]): (r["doc_id"], r["h"]) for r in repeated.toLocalIterator()})
        return _applied(docs, lambda b: [drop.value] * b.num_rows, first)

    def lines(batches: Iterator[pa.RecordBatch], suspects) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, xxhash.xxh64_intdigest(t) >> 1) for i, t in enumerate(b["text"].to_pylist()) for k in suspects.value.of(t)]
            at, key, h = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at, pa.int64())), pa.array(h, pa.int64()), pa.array(key, pa.binary())], ["doc_id", "h", "key"])

    # A document is told by its id and text: rows that share both lose the same lines.
    one = lambda shipped: docs.select("doc_id", "text").mapInArrow(partial(lines, suspects=shipped), f"doc_id {id_type}, h long, key binary")
    hits = (one(filters[0]) if len(filters) == 1 else reduce(DataFrame.unionByName, [written(one(x), "suspected-lines") for x in filters])).distinct()
    owners = repeated.select("key", F.col("doc_id").alias("own_id"), F.col("h").alias("own_h"))
    per_doc = hits.join(owners, "key").groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "own_id", "own_h")).alias("drop"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [xxhash.xxh64_intdigest(t) >> 1 if t else None for t in pc.struct_field(b["row"], "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b["row"], b["d"], pa.array(h, pa.int64())], ["row", "d", "th"])

    marked = whole.mapInArrow(mark, whole.withColumn("th", F.lit(None).cast("long")).schema)
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("h"))
    joined = marked.join(per_doc, same, "left").select("row.*", F.col("drop").alias("_drop"))

    def own(b: pa.RecordBatch) -> list[dict]:
        return [{x["key"]: (x["own_id"], x["own_h"]) for x in d or []} for d in b["_drop"].to_pylist()]

    return _applied(joined, own, first)


def _applied(docs: DataFrame, drops, first: bool) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name != "_drop"]
    out = docs.drop("_drop").withColumns({"_n_lines": F.lit(0).cast("long"), "_n_dropped": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for doc_id, text, drop in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), drops(b)):
                lines, keys = keys_of(text)
                at = (doc_id, xxhash.xxh64_intdigest(text) >> 1) if first and text else None
                mine: set[bytes] = set()
                left = []
                for line, key in zip(lines, keys):
                    if key in drop:
                        if not (first and drop[key] == at and key not in mine):
                            continue
                        mine.add(key)
                    left.append(line)
                texts.append(text if len(left) == len(lines) else b"\n".join(left).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            columns = [pa.array(texts, b["text"].type) if f.name == "text" else b[f.name] for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*(f.name for f in kept), "_n_lines", "_n_dropped"])

    return docs.mapInArrow(run, out)
