"""Token files: concatenated ids with Elias-Fano document boundaries.

A file is a row of a Parquet table (so that any store Spark reaches can hold it) and has about ``BLOCK_TOKENS``
tokens: ``ids`` is the concatenation of its documents' ids, little-endian, two bytes each where the
vocabulary allows it, else four; ``ends`` is the Elias-Fano code of the documents' ends with a select
directory, about 2 + log2(tokens per document) bits for a document; ``doc_ids`` names the documents.  Files
follow the order of doc_id: shard by shard (a shard is one task's range), block by block.  ``before`` is the
number of ids ahead of the block in its shard.

Elias-Fano: with n ends below u, each end's lowest floor(log2(u / n)) bits are stored as they are;
the rest as unary gaps in a bit row, where the i-th one stands at (end >> low) + i.  ``select`` finds that one from a
32-bit count for each 512 bits.

Defined cases: NULL text is an empty text, which still has the end id.  Rows are ordered by doc_id (NULL first),
then by a hash of the text, so repeated ids are all written and a hot id is spread over shards.  An empty table
gives no file and reads back as no rows.  Extra columns are not carried.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import shared_folder, small_batches
from shelfmark.llm.tokens import encoder

BLOCK_TOKENS = 1 << 21
_SUPER = 512


class EliasFano:
    """Of a non-decreasing sequence of numbers up to ``universe``."""

    def __init__(self, data: bytes):
        self.n, self.universe, self.low, high, supers = struct.unpack_from("<QQBII", data)
        at = struct.calcsize("<QQBII")
        self.counts = np.frombuffer(data, "<u4", supers, at)
        at += 4 * supers
        self.high = np.frombuffer(data, np.uint8, high, at)
        self.lows = np.frombuffer(data, np.uint8, offset=at + high)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        values = values.astype(np.uint64)
        low = max(0, (universe // n).bit_length() - 1) if n else 0
        high = np.zeros(-(-(n + (universe >> low) + 1) // _SUPER) * _SUPER, np.uint8)
        high[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
        counts = np.concatenate([[0], np.cumsum(high.reshape(-1, _SUPER).sum(axis=1, dtype=np.int64))[:-1]]).astype("<u4")
        lows = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(high, bitorder="little")
        head = struct.pack("<QQBII", n, universe, low, len(packed), len(counts))
        return head + counts.tobytes() + packed.tobytes() + np.packbits(lows.ravel(), bitorder="little").tobytes()

    def select(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), 4096):
            part = np.asarray(i[k : k + 4096], np.int64)
            block = np.searchsorted(self.counts, part, "right") - 1
            bits = np.unpackbits(self.high.reshape(-1, _SUPER // 8)[block], axis=1, bitorder="little")
            place = (np.cumsum(bits, axis=1, dtype=np.int32) > (part - self.counts[block])[:, None]).argmax(axis=1)
            upper = block * _SUPER + place - part
            at = part[:, None] * self.low + np.arange(self.low)
            lower = (((self.lows[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(self.low)).sum(axis=1)
            out[k : k + 4096] = (upper << self.low) + lower
        return out


def _columns(kind: str) -> str:
    return f"shard int, block int, before long, n_docs long, n_tokens long, width int, doc_ids array<{kind}>, ids binary, ends binary"


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> str:
    """Encode ``docs`` (doc_id, text, ...) into token files; returns their folder."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_folder(spark, "token-files")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    order = ["doc_id", "h"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, parts, ends, before, block, size = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4").astype("<u2" if width == 2 else "<u4").tobytes()
            row = [[shard], [block], [before], [len(ends)], [size], [width], [doc_ids], [ids], [EliasFano.encode(np.array(ends), size)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), None, pa.binary(), pa.binary()]
            arrays = [pa.array(x, t) if t is not None else pa.array(x, pa.list_(id_type)) for x, t in zip(row, types)]
            return pa.RecordBatch.from_arrays(arrays, ["shard", "block", "before", "n_docs", "n_tokens", "width", "doc_ids", "ids", "ends"])

        for b in batches:
            id_type = b["doc_id"].type
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                ids = enc.encode(text) + end
                doc_ids.append(doc_id)
                parts.append(ids)
                size += len(ids) // 4
                ends.append(size)
                if size >= block_tokens:
                    yield flush()
                    doc_ids, parts, ends, before, block, size = [], [], [], before + size, block + 1, 0
        if ends:
            yield flush()

    placed.mapInArrow(run, _columns(kind)).write.parquet(path)
    return path


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document of the files in ``path``."""
    small_batches(spark)
    files = spark.read.parquet(path)
    # One row for each shard, and a shard is a partition of the writer: a count that the writer's settings bound.
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = shards.select(
        "shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    placed = files.join(F.broadcast(base), "shard").withColumn("at", F.col("base") + F.col("before"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = np.frombuffer(b["ids"][k].as_py(), "<u2" if b["width"][k].as_py() == 2 else "<u4").astype("<u4")
                ends = EliasFano(b["ends"][k].as_py())
                stop = ends.select(np.arange(ends.n))
                start = np.concatenate([[0], stop[:-1]])
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(start, stop)]
                doc_ids = b["doc_ids"][k].values
                out = [doc_ids, pa.array(start + b["at"][k].as_py()), pa.array(stop - start), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([ids[s:e].astype(np.int32) for s, e in zip(start, stop)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return placed.select("doc_ids", "ids", "ends", "width", "at").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    )
