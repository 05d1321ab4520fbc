"""Bloom filters that Spark tasks fill and that are merged slice by slice.

A filter has a fixed number of bits, chosen by the caller and at most ``MOST_BITS``, so it may be broadcast at
any input size; a fuller filter lets more through, which costs time in later exact steps but no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_BITS = 1 << 28
HASHES = 3
_SLICE = 1 << 17  # bytes


def bits_for(items: int) -> int:
    return min(MOST_BITS, max(_SLICE * 8, 1 << (12 * max(items, 1) - 1).bit_length()))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit places of each unsigned 64-bit hash; ``bits`` is a power of two."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)


class Pair:
    """The filter of hashes seen once and that of hashes seen twice."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Each appearance of a hash counts; a hash that is seen again goes to ``twice`` too."""
        distinct, n = np.unique(hashes, return_counts=True)
        again = distinct[(n > 1) | within(self.once, distinct)]
        _set(self.twice, places(again, self.bits))
        _set(self.once, places(distinct, self.bits))

    def slices(self) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.once), _SLICE):
            if self.once[k : k + _SLICE].any():
                row = [[k // _SLICE], *([zlib.compress(x[k : k + _SLICE].tobytes(), 1)] for x in (self.once, self.twice))]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(x, pa.binary()) for x in row[1:])], ["slice", "once", "twice"])


SCHEMA = "slice int, once binary, twice binary"


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, (at >> np.uint64(3)).ravel().astype(np.int64), (1 << (at & np.uint64(7)).ravel().astype(np.uint8)).astype(np.uint8))


def within(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have all their bits set."""
    at = places(hashes, len(bits) * 8)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice: what two tasks have both seen once was seen twice."""
    pair, at = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in pair)], ["slice", "once", "twice"])

    for b in batches:
        for k, once, twice in zip(b["slice"].to_pylist(), b["once"].to_pylist(), b["twice"].to_pylist()):
            if k != at:
                if pair:
                    yield out()
                pair, at = [np.zeros(_SLICE, np.uint8), np.zeros(_SLICE, np.uint8)], k
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
            pair[1] |= t | (pair[0] & o)
            pair[0] |= o
    if pair:
        yield out()


def merged(parts: DataFrame, bits: int) -> Pair:
    """``parts``: the slices of all tasks.  The filters come to the driver; their size is fixed by ``bits``."""
    pair = Pair(bits)
    for r in parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge, SCHEMA).toLocalIterator():
        for name in ("once", "twice"):
            getattr(pair, name)[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(zlib.decompress(r[name]), np.uint8)
    return pair
