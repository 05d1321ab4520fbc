"""Exact deduplication with an extendible-hash index on shared files.

The key of a text is the 64-bit hash of its normalised form.  Keys that several documents share are
indexed: the directory starts with one bucket and doubles, splitting overfull buckets by their next key
bit, until every bucket's text fits ``bucket_bytes`` or ``DEPTH`` bits are used.  Each bucket belongs to an
owner task, which reads its key range in key order and chains the texts of a key by their bytes: texts that collide in
key, or in key and digest, get places of their own.  A place has the number of its documents and the least doc_id, and these are
the classes; they are written as the index files in the shared folder and joined to the documents by key and digest (and
by the text itself where two texts of a key share their digest).

What is shuffled is small: keys and digests of all documents, counted per task first, and the texts
of repeated keys only, once for each batch of a task with their count and least doc_id.  The keys of very large groups (more than one row in
``HEAVY``, so fewer than HEAVY keys) are spread over ``SALTS`` owners first, each of which merges its share and
passes one place for each text on.  A Bloom filter of fixed size tells which texts those
may be; a false hit is a chain of one.  A bucket that is still overfull at full depth (one key, or more text than
DEPTH bits can part) needs no more memory, because an owner holds one key's chain at a time.

Defined cases: NULL text counts as empty.  The smallest doc_id stays, NULL being the largest; of rows that
repeat the smallest one exactly one stays.  An empty table gives no rows.  Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import bloom
from shelfmark.llm.common import small_batches, written

DEPTH = 16
HEAVY, SALTS = 4096, 64
LEAST_BYTES = 1 << 14


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class Directory:
    """Extendible hashing over the first DEPTH bits of a key."""

    def __init__(self, loads: np.ndarray, capacity: int):
        self.depth, self.slots, self.local = 0, [0], [(0, 0)]  # slot -> bucket; bucket -> (local depth, prefix)
        total = np.concatenate([[0], np.cumsum(loads)])

        def load(bucket: int) -> int:
            d, prefix = self.local[bucket]
            return int(total[(prefix + 1) << (DEPTH - d)] - total[prefix << (DEPTH - d)])

        check = [0]
        while check:
            b = check.pop()
            d, prefix = self.local[b]
            if load(b) <= capacity or d == DEPTH:
                continue
            if d == self.depth:  # double the directory
                self.slots, self.depth = [s for s in self.slots for _ in (0, 1)], d + 1
            new = len(self.local)
            self.local[b] = (d + 1, prefix * 2)
            self.local.append((d + 1, prefix * 2 + 1))
            shift = self.depth - d - 1
            for s in range((prefix * 2 + 1) << shift, (prefix * 2 + 2) << shift):
                self.slots[s] = new
            check += [b, new]
        self.table = np.array(self.slots, np.int32)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(keys), np.int32)
        return self.table[(keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


_ENTRY = pa.schema([("key", pa.int64()), ("sha", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("no_id", pa.bool_()), ("doc_id", pa.int64()), ("owner", pa.int32()), ("salt", pa.int32())])
_ENTRY_DDL = "key long, sha string, text string, n long, no_id boolean, doc_id long, owner int, salt int"
_PLACE = pa.schema([("key", pa.int64()), ("sha", pa.string()), ("place", pa.int32()), ("n", pa.int64()), ("no_id", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string()), ("twin", pa.bool_()), ("owner", pa.int32()), ("salt", pa.int32())])
_PLACE_DDL = "key long, sha string, place int, n long, no_id boolean, doc_id long, text string, twin boolean, owner int, salt int"


def _least(a: tuple[bool, int | None], b: tuple[bool, int | None]) -> tuple[bool, int | None]:
    return min(a, b, key=lambda x: (x[0], x[1] or 0))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in (salt, key) order -> the places of each key's chain: one for each distinct text, by its bytes.  The text goes with a place
    that is a share of a heavy key (salt 1 and up), because its owner compares it again, and with ``twin`` places, whose digest
    another text of the key has too."""
    at, chain, out = None, {}, []

    def close() -> None:
        digests: dict[str, int] = {}
        for sha, *_ in chain.values():
            digests[sha] = digests.get(sha, 0) + 1
        for place, (text, (sha, n, first, owner)) in enumerate(chain.items()):
            twin = digests[sha] > 1
            out.append((at[1], sha, place, n, *first, text if twin or at[0] else None, twin, owner, at[0]))

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [()] * len(_PLACE), _PLACE)], schema=_PLACE)

    for b in batches:
        for key, sha, text, n, no_id, doc_id, owner, salt in zip(*(b[c].to_pylist() for c in _ENTRY.names)):
            if (salt, key) != at:
                if chain:
                    close()
                at, chain = (salt, key), {}
            old = chain.get(text)
            chain[text] = (sha, n, (no_id, doc_id), owner) if old is None else (sha, old[1] + n, _least(old[2], (no_id, doc_id)), owner)
        if len(out) >= 1000:
            yield flushed()
            out.clear()
    if chain:
        close()
    yield flushed()


def classes(
    docs: DataFrame, bucket_bytes: int = 8 << 20, key: Callable[[Column], Column] = F.xxhash64, digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256)
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text, ...).  ``key`` and ``digest`` are other
    functions of the normalised text in tests only."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("text"))
    texts = texts.withColumns({"key": key(F.col("text")).cast("long"), "sha": digest(F.col("text"))})
    keyed = written(texts.select(
        "doc_id", "key", "sha", F.octet_length("text").alias("bytes"), F.monotonically_increasing_id().alias("row")
    ), "dedup-keys")
    # Only a filter and the sizes of the buckets: which documents are equal is settled by the owners.
    shared = written(
        keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("bytes").cast("long").alias("bytes")).where("n > 1"), "dedup-shared"
    )
    n_keys = shared.count()
    rows = shared.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = spark.sparkContext.broadcast({r["key"] for r in shared.where(F.col("n") > max(1000, rows // HEAVY)).select("key").collect()})
    loads = np.zeros(1 << DEPTH, np.int64)
    prefix = F.shiftrightunsigned("key", 64 - DEPTH)
    for r in shared.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("n")).collect():
        loads[r["p"]] = r["n"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Small tables are split further, so that all tasks own something.
    capacity = min(bucket_bytes, max(LEAST_BYTES, int(loads.sum()) // tasks))
    directory = spark.sparkContext.broadcast(Directory(loads, capacity))
    bits = bloom.bits_for(n_keys)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = bloom.Pair(bits)
        for b in batches:
            pair.add(b["key"].to_numpy().view(np.uint64))
        yield from pair.slices()

    suspects = spark.sparkContext.broadcast(bloom.merged(shared.select("key").mapInArrow(fill, bloom.SCHEMA), bits).once)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = count(TaskContext.get().partitionId())
        for b in batches:
            keys = b["key"].to_numpy()
            at = np.flatnonzero(bloom.within(suspects.value, keys.view(np.uint64)))
            few = b.take(pa.array(at, pa.int64()))
            found: dict[tuple[int, str], list] = {}
            for k, sha, text, doc_id in zip(*(few[c].to_pylist() for c in ("key", "sha", "text", "doc_id"))):
                own, first = (k, text), (doc_id is None, doc_id)
                old = found.get(own)
                found[own] = [sha, 1, first] if old is None else [sha, old[1] + 1, _least(old[2], first)]
            owner = directory.value.bucket(np.array([k for k, _ in found], np.int64)).tolist()
            salt = [1 + next(turn) % SALTS if k in heavy.value else 0 for k, _ in found]
            out = [(k, sha, text, n, *first, o, s) for ((k, text), (sha, n, first)), o, s in zip(found.items(), owner, salt)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [()] * len(_ENTRY), _ENTRY)], schema=_ENTRY)

    owners = max(len(directory.value.local), tasks)
    owned = lambda df: df.repartition(owners, "owner", "salt").sortWithinPartitions("salt", "key").mapInArrow(_chain, _PLACE_DDL)
    chains = written(owned(texts.select("key", "sha", "text", "doc_id").mapInArrow(entries, _ENTRY_DDL)), "dedup-index")
    shares = chains.where("salt > 0").select("key", "sha", "text", "n", "no_id", "doc_id", "owner", F.lit(0).alias("salt"))
    merged = written(owned(shares), "dedup-index-heavy")
    index = chains.where("salt = 0").unionByName(merged)
    # Rows that repeat id and text: the first of them is the one that may stay.
    again = keyed.groupBy("doc_id", "key", "sha").agg(F.count("*").alias("_n"), F.min("row").alias("_first")).where("_n > 1").drop("_n")
    again = written(again.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("sha").alias("_sha"), "_first"), "dedup-repeats")
    twins = index.where("twin")
    plain = written(index.where("NOT twin").select("key", "sha", "n", F.col("doc_id").alias("_keep")), "dedup-classes")
    joined = keyed.join(plain, ["key", "sha"], "left").withColumn("place", F.lit(0))
    if not twins.isEmpty():
        odd = twins.select("key", "sha").distinct()
        placed = written(texts.join(odd, ["key", "sha"], "left_semi").withColumn("row", F.monotonically_increasing_id()), "dedup-twins").join(
            twins.select("key", "sha", "text", "place", "n", F.col("doc_id").alias("_keep")), ["key", "sha", "text"]
        )
        cols = ["doc_id", "key", "sha", "row", "place", "n", "_keep"]
        firsts = placed.groupBy("doc_id", "key", "sha", "place").agg(F.min("row").alias("_first"))
        mine = placed.select(*cols).join(firsts.select(
            F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("sha").alias("_sha"), F.col("place").alias("_place"), "_first"
        ), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")) & (F.col("sha") == F.col("_sha")) & (F.col("place") == F.col("_place")), "left")
        joined = joined.join(odd, ["key", "sha"], "left_anti")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")) & (F.col("sha") == F.col("_sha"))
    out = joined.withColumn("_first", F.lit(None).cast("long")) if again.isEmpty() else joined.join(again, same, "left")
    needed = ["doc_id", "sha", "n", "_keep", "row", "_first"]
    out = out.select(*needed)
    if not twins.isEmpty():
        out = out.unionByName(mine.select(*needed))
    alone = F.col("n").isNull()
    return out.select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).cast(kind).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("_keep")) & F.coalesce(F.col("row") == F.col("_first"), F.lit(True)))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
