"""Equal files by their bytes, reading as little as the answer needs."""

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.stable import pinned, spread

FIRST_BLOCK = 1 << 16
CHUNK = 1 << 22


def _hashes(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """SHA-256 of at most the first ``most`` bytes of each path, and the bytes read; NULL if it can't be read."""
    from pyarrow import fs

    stores: dict[str, fs.FileSystem] = {}

    def one(path: str) -> tuple[str | None, int]:
        scheme = path[: path.index("/", path.index("://") + 3)] if "://" in path else ""
        done, digest = 0, sha256()
        try:
            if scheme not in stores:
                stores[scheme] = fs.FileSystem.from_uri(f"{scheme}/")[0] if scheme else fs.LocalFileSystem()
            with stores[scheme].open_input_stream(path[len(scheme) :], buffer_size=0) as f:
                while part := f.read(CHUNK if most is None else min(CHUNK, most - done)):
                    digest.update(part)
                    done += len(part)
        except (OSError, pa.ArrowException):
            return None, done
        return digest.hexdigest(), done

    for b in batches:
        found = [one(p) for p in b["path"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["path"], pa.array([h for h, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "hash", "read"])


def _shared(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows whose keys another row has too."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    rows = rows.withColumns(named)
    groups = rows.groupBy(*named).agg(F.count("*").alias("_n")).where("_n > 1").select(*named)
    return rows.join(groups, list(named), "left_semi").drop(*named)


def staged_hashes(files: DataFrame, same: list[str] | None = None, block: int = FIRST_BLOCK) -> DataFrame:
    """(path, size, sha256, bytes_read) of ``files`` (path, size and the columns ``same`` in which copies agree; paths are unique).

    Files whose size (and ``same``) nobody shares are not opened.  Of the others the first block is hashed, and only those
    that still share everything are read whole, unless the block was all of them.  Each step is a grouped count and a semi-join,
    and hashes are kept when they are made, so no file is read twice for a lost task of a later step.  ``sha256`` is NULL for files
    that have no copy by then or can't be read."""
    keys = [F.col("size"), *[F.col(c) for c in same or []]]
    sized = pinned(_shared(files.select("path", "size", *(same or [])).where("size IS NOT NULL"), keys))
    heads = pinned(spread(sized.select("path"), "path").mapInArrow(lambda b: _hashes(b, block), "path string, hash string, read bigint"))
    rows = sized.join(heads, "path")
    alike = pinned(_shared(rows.where("hash IS NOT NULL"), [*keys, F.col("hash")]))
    large = alike.where(F.col("size") > block).select("path")
    whole = pinned(spread(large, "path").mapInArrow(lambda b: _hashes(b, None), "path string, hash string, read bigint"))
    small = alike.where(F.col("size") <= block).select("path", "hash", F.lit(0).cast("bigint").alias("read"))
    final = small.unionByName(whole).select("path", F.col("hash").alias("sha256"), F.col("read").alias("_more"))
    read = heads.select("path", "read")
    return files.select("path", "size", *(same or [])).join(read, "path", "left").join(final, "path", "left").select(
        "path", "size", *(same or []), "sha256", (F.coalesce("read", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("bytes_read")
    )
