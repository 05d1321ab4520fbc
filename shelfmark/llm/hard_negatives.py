"""Hard negatives by rotated one-bit codes.

``index`` rotates each vector by a fixed random orthogonal matrix and stores the signs as a one-bit code, the alignment of code and
vector (their inner product, the code scaled to length 1), the norm and the vector's whole-number components.  An anchor is
rotated alike and cut to ``PLANES`` bit planes; the popcounts of its planes with a code estimate the anchor's product with the code.
That product times the alignment estimates the score.  What it leaves out is the product of the anchor's and the vector's parts that stand
at right angles to the code, which Cauchy and Schwarz bound by the product of their lengths; with the rounding of the planes this
gives an interval that holds the score for certain.  Only rows whose interval reaches what is asked for (the k-th best so
far, the band of allowed scores) are scored in whole numbers, so the result is exact.

``mine`` takes the anchors in blocks of at most ``BLOCK`` and, for each block, passes over the index twice: for the positives, whose
scores set the bands, and for the negatives.  Tasks keep the best k of each anchor (and band); these are merged by a ranked window.

Defined cases: rows with a NULL label, a NULL vector, a NULL or non-finite component, or one that scaled exceeds 2^26 (their products might
leave 64 bits) take no part.  Missing components of a shorter vector count as 0.  Equal scores come by ascending id, NULL last.
Rows that share an anchor's id are not its partners.  Repeated rows take part one by one; repeated equal anchors are one anchor.
An anchor without positives, or a positive without rows in its band, has no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import small_batches, written

PLANES = 6
BLOCK = 2048
CHUNK_ROWS, CHUNK_ANCHORS = 1 << 13, 128
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min
MOST = 1 << 26
SCHEMA = "vec_id long, label long, code binary, align double, norm double, parts binary"


def rotation(width: int, seed: int = 42) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q


def vectors(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, parts): the rows that take part, their components scaled and rounded down."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("parts", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > MOST))
    return (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.lit(scale) * c).alias("parts"))
        .where(F.col("label").isNotNull() & F.col("parts").isNotNull() & ~bad)
        .withColumn("parts", F.transform("parts", lambda c: F.floor(c).cast("int")))
    )


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass
class Codes:
    """Of some rows: packed signs, alignment, norm and length at right angles to the code."""

    words: np.ndarray
    align: np.ndarray
    norm: np.ndarray

    @property
    def rest(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm**2 - self.align**2, 0))


def encode(parts: np.ndarray, turn: np.ndarray) -> Codes:
    turned = parts @ turn
    bits = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64)
    align = np.abs(turned).sum(axis=1) / np.sqrt(parts.shape[1])
    return Codes(bits, align, np.sqrt((parts.astype(np.float64) ** 2).sum(axis=1)))


def index(rows: DataFrame) -> tuple[DataFrame, int]:
    """The codes of ``vectors(...)`` as a table in the shared folder, and the width of its vectors."""
    spark = rows.sparkSession
    small_batches(spark)
    width = -(-max(rows.agg(F.max(F.size("parts"))).first()[0] or 1, 1) // 64) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(width)
        for b in batches:
            parts = _matrix(b["parts"], width)
            codes = encode(parts, turn)
            yield pa.RecordBatch.from_arrays([
                b["vec_id"], b["label"], pa.array([x.tobytes() for x in codes.words], pa.binary()), pa.array(codes.align),
                pa.array(codes.norm), pa.array([x.tobytes() for x in parts], pa.binary()),
            ], ["vec_id", "label", "code", "align", "norm", "parts"])

    # Searching costs far more than reading, so a small table is dealt to all cores too.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return written(rows.repartition(n).mapInArrow(run, SCHEMA), "one-bit-codes"), width


class Estimator:
    """Intervals of the scores of some anchors with coded rows."""

    def __init__(self, parts: np.ndarray, turn: np.ndarray):
        turned = parts @ turn
        self.width = turned.shape[1]
        self.norm = np.sqrt((parts.astype(np.float64) ** 2).sum(axis=1))
        self.low = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.low, 1e-12) / (2**PLANES - 1)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.sum = levels.sum(axis=1, dtype=np.int64)
        self.error = np.sqrt(((turned - self.low[:, None] - self.step[:, None] * levels) ** 2).sum(axis=1))
        self.planes = [np.packbits((levels >> p) & 1, axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)]

    def intervals(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score of each anchor (row) with each coded row (column)."""
        ones = np.bitwise_count(codes.words).sum(axis=1, dtype=np.int32)
        inside = np.zeros((len(self.norm), len(codes.words)), np.int32)
        for p, plane in enumerate(self.planes):
            for w in range(plane.shape[1]):
                inside += np.bitwise_count(plane[:, w, None] & codes.words[None, :, w]).astype(np.int32) << p
        product = self.low[:, None] * (2 * ones - self.width) + self.step[:, None] * (2 * inside - self.sum[:, None])
        product /= np.sqrt(self.width)
        beside = np.maximum(np.abs(product) - self.error[:, None], 0)
        beside = np.sqrt(np.maximum(self.norm[:, None] ** 2 - beside**2, 0))
        room = codes.align * self.error[:, None] + beside * codes.rest + 1e-9 * (1 + self.norm[:, None] * codes.norm)
        product *= codes.align
        return product - room, product + room


class Top:
    """The ``k`` best (score, id) of each group so far."""

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, LEAST, np.int64)
        self.group, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        by = np.lexsort((ids, -score, group))
        group, score, ids = group[by], score[by], ids[by]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        keep = place < self.k
        self.group, self.score, self.id = group[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.least[group[full]] = score[full]


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    parts: np.ndarray


def _scores(a: np.ndarray, b: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, inner product) of the pairs asked for, in whole numbers."""
    i, j = np.nonzero(asked)
    exact = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53
    if exact and len(i) * 8 > asked.size:  # doubles below 2^53 are whole numbers too
        return i, j, (a.astype(np.float64) @ b.T.astype(np.float64))[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), 1 << 16):
        c = slice(lo, lo + (1 << 16))
        out[c] = np.einsum("ij,ij->i", a[i[c]], b[j[c]], dtype=np.int64)
    return i, j, out


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, Codes, np.ndarray]]:
    """(ids, labels, codes, parts) of up to about CHUNK_ROWS rows."""

    def joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, Codes, np.ndarray]:
        t = pa.Table.from_batches(held)
        ids = t["vec_id"].fill_null(NO_ID).to_numpy()
        raw = lambda c, kind, n: np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(-1, n)
        return ids, t["label"].to_numpy(), Codes(raw("code", np.uint64, width // 64), t["align"].to_numpy(), t["norm"].to_numpy()), raw("parts", np.int32, width)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= CHUNK_ROWS:
            yield joined(held)
            held, size = [], 0
    if size:
        yield joined(held)


def _searched(indexed: DataFrame, width: int, block: Anchors, k: int, low: np.ndarray | None, high: np.ndarray | None) -> DataFrame:
    """(_g, _id, score): each task's best ``k`` of each group.  Without bands a group is an anchor and its partners have its
    label; with bands (anchors by bands of least and greatest scores) a group is (anchor, band) and they have another."""
    shipped = indexed.sparkSession.sparkContext.broadcast((block, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, lows, highs = shipped.value
        bands = 1 if lows is None else lows.shape[1]
        best, turn = Top(len(a.ids) * bands, k), rotation(width)
        estimators = [Estimator(a.parts[lo : lo + CHUNK_ANCHORS], turn) for lo in range(0, len(a.ids), CHUNK_ANCHORS)]
        for ids, labels, codes, parts in _chunks(batches, width):
            for n, estimator in enumerate(estimators):
                lo = n * CHUNK_ANCHORS
                own = slice(lo, lo + len(estimator.norm))
                partner = (a.labels[own, None] == labels) == (lows is None)
                partner &= a.ids[own, None] != ids
                least, most = estimator.intervals(codes)
                if lows is None:
                    bar = np.maximum(best.least[own], _kth(np.where(partner, least, -np.inf), k))
                    i, j, score = _scores(a.parts[own], parts, partner & (most >= bar[:, None]))
                    keep = score >= best.least[lo + i]
                    best.add(lo + i[keep], score[keep], ids[j[keep]])
                else:
                    bars = np.maximum(lows[own], best.least.reshape(-1, bands)[own])
                    reach = np.zeros_like(partner)
                    for band in range(bands):
                        reach |= (most >= bars[:, band, None]) & (least <= highs[own, band, None])
                    i, j, score = _scores(a.parts[own], parts, partner & reach)
                    found = []
                    for band in range(bands):
                        keep = (score >= bars[i, band]) & (score <= highs[own][i, band])
                        found.append(((lo + i[keep]) * bands + band, score[keep], ids[j[keep]]))
                    best.add(*(np.concatenate(x) for x in zip(*found)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (best.group, best.id, best.score)], ["_g", "_id", "score"])

    return indexed.mapInArrow(run, "_g long, _id long, score long")


def _kth(least: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, rounded down; -inf with fewer."""
    if least.shape[1] < k:
        return np.full(len(least), LEAST, np.float64)
    return np.maximum(np.floor(np.partition(least, -k, axis=1)[:, -k]), LEAST)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("_g").orderBy(F.desc("score"), "_id"))).where(F.col("rank") <= k)


def _blocks(anchors: DataFrame, width: int) -> Iterator[Anchors]:
    def block(rows: list) -> Anchors:
        parts = np.frombuffer(b"".join(bytes(r["parts"]) for r in rows), np.int32).reshape(-1, width)
        return Anchors(np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), parts)

    held = []
    for r in anchors.toLocalIterator():
        held.append(r)
        if len(held) == BLOCK:
            yield block(held)
            held = []
    if held:
        yield block(held)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``rows``: of ``vectors``.  Anchors are the rows whose id is divisible by ``every``; for each anchor and each of its ``positives`` best
    rows of one label the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent of the positive's."""
    spark = rows.sparkSession
    indexed, width = index(rows)
    anchors = indexed.where(F.col("vec_id") % every == 0).select("vec_id", "label", "parts").distinct()
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    no_id = lambda c: F.nullif(c, F.lit(NO_ID))
    parts = []
    for block in _blocks(anchors, width):
        best = _ranked(_searched(indexed, width, block, positives, None, None), positives).collect()  # at most BLOCK x positives
        shape = (len(block.ids), positives)
        lows, highs = np.ones(shape, np.int64), np.zeros(shape, np.int64)
        known = []
        for r in best:
            g, n, p = r["_g"], r["rank"] - 1, r["score"]
            lows[g, n], highs[g, n] = -(-low * p // 100), high * p // 100
            known.append((g * positives + n, int(block.ids[g]), r["_id"], p))
        bands = spark.createDataFrame(known, "_g long, anchor_id long, positive_id long, positive_score long")
        found = _ranked(_searched(indexed, width, block, negatives, lows, highs), negatives)
        parts.append(written(found.join(F.broadcast(bands), "_g").select(
            "anchor_id", no_id(F.col("positive_id")).alias("positive_id"), "rank", no_id(F.col("_id")).alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ), "hard-negatives"))
    for part in parts:
        out = out.unionByName(part)
    return out
