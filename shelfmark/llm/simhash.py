"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are split into ``blocks`` blocks.  If two differ in at most ``distance`` bits, at
least blocks - distance of their blocks are alike, so they meet in the bucket of those blocks: there is one
bucket key for each choice of that many blocks (20 keys of about 32 bits for 6 blocks and distance 3).  In a
bucket the Hamming distances are verified and the links are given as a forest: a search from a
fingerprint takes up all that are near it and never looks at them again, so a dense group costs
about one pass and gives one link for each member, not all pairs.  The components of all links are the groups.

Documents of one fingerprint are combined first, so a third of all rows being copies is one member of a bucket.  A
bucket of more than ``SLICE`` fingerprints is cut into slices, and each two slices are a group of their own:
every pair still meets, and no task holds more than two slices.

Defined cases: NULL, empty and blank texts have fingerprint zero and are linked like others.  The
component is named by its smallest doc_id; NULL ids count only where there is no other.  Of repeated rows
``survivors`` keeps one.  An empty table gives no rows.  ``components_of`` carries no extra columns, ``survivors`` all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import guarded, small_batches, written
from shelfmark.operators.components import components

SHINGLE, SEED = 3, 42
SLICE = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    stop = ends[size - 1 :].tolist()
    start = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    n, ones = len(stop), np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(start[k : k + _CHUNK], stop[k : k + _CHUNK])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def masks(blocks: int, distance: int) -> list[int]:
    """A mask of the bits that must agree, for each choice of blocks."""
    if not 0 <= distance < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    edge = [64 * k // blocks for k in range(blocks + 1)]
    part = [((1 << (edge[k + 1] - edge[k])) - 1) << edge[k] for k in range(blocks)]
    return [sum(c) for c in combinations(part, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join all members within ``distance`` of each other, one for each member reached."""
    left, links = np.unique(prints.astype(np.int64).view(np.uint64)), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            p = reached.pop()
            near = np.bitwise_count(left ^ p) <= distance
            if near.any():
                found = left[near]
                links += [(signed(int(p)), signed(x)) for x in found.tolist()]
                reached.extend(found)
                left = left[~near]
    return links


def _fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """All columns, with ``_print`` and a row number ``_row``."""
    out = docs.withColumns({"_print": F.lit(0).cast("long"), "_row": F.monotonically_increasing_id()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([signed(fingerprint(t, shingle)) for t in b["text"].to_pylist()], pa.int64())
            yield b.set_column(b.schema.get_field_index("_print"), "_print", prints)

    return out.mapInArrow(run, out.schema)


def linked(prints: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b): links between different values of ``prints._print`` that join all near ones."""
    small_batches(prints.sparkSession)
    keyed = prints.select("_print").distinct().select(
        "_print", F.posexplode(F.array(*[F.col("_print").bitwiseAND(F.lit(signed(m))) for m in masks(blocks, distance)])).alias("c", "v")
    )
    large = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).where(F.col("n") > SLICE)
    slices = F.coalesce(F.ceil(F.col("n") / SLICE), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("_print"), F.col("slices")).cast("int")
    sliced = keyed.join(large, ["c", "v"], "left").withColumn("slices", slices).withColumn("i", mine)
    # The groups (i, j) with i <= j that a slice takes part in; just (0, 0) for a bucket of one slice.
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("k")
    grouped = sliced.select("_print", "c", "v", "i", other).select(
        "_print", "c", "v", F.least("i", "k").alias("i"), F.greatest("i", "k").alias("j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            rows = np.stack([b[c].to_numpy().astype(np.int64) for c in ("c", "v", "i", "j", "_print")], axis=1)
            if rest is not None:
                rows = np.concatenate([rest, rows])
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            if not len(cut):
                rest = rows
                continue
            rest = rows[cut[-1] :]
            yield from _links(rows[: cut[-1]], cut, distance)
        if rest is not None:
            cut = np.flatnonzero((rest[1:, :4] != rest[:-1, :4]).any(axis=1)) + 1
            yield from _links(rest, np.append(cut, len(rest)), distance)

    keys = ["c", "v", "i", "j"]
    return grouped.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def _links(rows: np.ndarray, stop: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    start = np.concatenate([[0], stop[:-1]])
    links = [x for s, e in zip(start, stop) if e - s > 1 for x in forest(rows[s:e, 4], distance)]
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])


def _components(rows: DataFrame, distance: int, blocks: int) -> DataFrame:
    """_print, keep: of every fingerprint, the (no id, doc_id, row) that stands first in its component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))
    nodes = written(rows.groupBy("_print").agg(first.alias("first")), "simhash-prints")
    roots = components(linked(nodes, distance, blocks), "a", "b").withColumnRenamed("node", "_print")
    named = nodes.join(roots, "_print", "left").withColumn("root", F.coalesce("root", "_print"))
    return named.select("_print", "root").join(named.groupBy("root").agg(F.min("first").alias("keep")), "root").select("_print", "keep")


def components_of(docs: DataFrame, distance: int = 3, blocks: int = 6, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text, ...)."""
    small_batches(docs.sparkSession)
    rows = written(_fingerprints(docs.select("doc_id", "text"), shingle).drop("text"), "simhash-rows")
    named = _components(rows, distance, blocks)
    return rows.join(named, "_print").select(
        "doc_id", F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"), F.col("keep.doc_id").alias("component_id")
    )


def survivors(docs: DataFrame, distance: int = 3, blocks: int = 6, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns kept: one of each component, that of the smallest doc_id."""
    small_batches(docs.sparkSession)

    def run(docs: DataFrame) -> DataFrame:
        rows = written(_fingerprints(docs, shingle), "simhash-documents")
        named = _components(rows.select("doc_id", "_print", "_row"), distance, blocks)
        return rows.join(named.select(F.col("keep._row").alias("_row")).distinct(), "_row", "left_semi")

    return guarded(docs, ["_print", "_row"], run)
