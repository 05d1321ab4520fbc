"""File listings: roots, recursion, the archive filter and the quarantine folder."""

import os
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv
from shelfmark.functions import rx
from shelfmark.functions.text import basename, clean_path, extension, whole_number
from shelfmark.operators.stable import ensure_checkpoint_dir, spread

QUARANTINE = ".quarantine"


def normalise_roots(roots: list[str], output_root: str | None = None) -> tuple[list[str], str]:
    """Trimmed, cleaned, distinct roots in given order (1 to 32); the output root defaults to
    the first one and is appended when it is not among them."""
    out: list[str] = []
    for raw in roots:
        root = posixpath.normpath(raw.strip()) if raw.strip() else ""
        if not root.startswith("/"):
            raise ValueError("every library root must be an absolute path")
        if root not in out:
            out.append(root)
    if not 1 <= len(out) <= fv.MAX_ROOTS:
        raise ValueError("select 1 to 32 library roots")
    target = posixpath.normpath(output_root.strip()) if output_root and output_root.strip() else out[0]
    if target not in out:
        out.append(target)
    return out, target


def listing_order(root_ord: Column, rel: Column) -> Column:
    """Sort key of a depth-first, name-ordered walk: compare path parts, not path bytes."""
    return F.concat(F.lpad(root_ord.cast("string"), 3, "0"), F.lit("\x01"), F.translate(rel, "/", "\x01"))


ENTRY_SCHEMA = (
    "root_ord int, root string, kind string, path string, size bigint, modified timestamp, error string"
)


def _entries(batches: Iterator[pa.RecordBatch], include_quarantine: bool, quarantine: str) -> Iterator[pa.RecordBatch]:
    """The children of each folder: files, folders to go on with, and an error row for what can't be read."""
    from pyarrow import fs

    stores: dict[str, fs.FileSystem] = {}
    names = [f.split()[0] for f in ENTRY_SCHEMA.split(", ")]
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    rows: list[tuple] = []
    for b in batches:
        for root_ord, root, path in zip(b["root_ord"].to_pylist(), b["root"].to_pylist(), b["path"].to_pylist()):
            scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]*", path)
            scheme = scheme[0] if scheme else "file://"
            bare = path[len(scheme) :] if path.startswith(scheme) else path
            try:
                if scheme not in stores:
                    stores[scheme] = fs.LocalFileSystem() if scheme == "file://" else fs.FileSystem.from_uri(f"{scheme}/")[0]
                found = stores[scheme].get_file_info(fs.FileSelector(bare))
            except (OSError, pa.ArrowException, ValueError) as e:
                rows.append((root_ord, root, "error", path, None, None, str(e).split(". Detail")[0]))
                continue
            for f in found:
                child = f"{path.rstrip('/')}/{f.base_name}"
                if f.type == fs.FileType.Directory:
                    # A link to a folder is neither followed nor a regular file.
                    linked = scheme == "file://" and os.path.islink(f.path)
                    if not linked and (include_quarantine or f.base_name != quarantine):
                        rows.append((root_ord, root, "folder", child, None, None, None))
                elif f.type == fs.FileType.File and not (scheme == "file://" and os.path.islink(f.path)):
                    at = None if f.mtime_ns is None else f.mtime_ns // 1000
                    rows.append((root_ord, root, "file", child, f.size, at, None))
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
    yield batch(rows)


def walk(spark: SparkSession, roots: list[str], include_quarantine: bool = False, quarantine: str = QUARANTINE) -> DataFrame:
    """(root_ord, root, kind, path, size, modified, error) of all that lies below the roots; kind is ``file``, ``folder`` or ``error``.

    The tree is listed level by level: the folders that one level finds are dealt out anew as the tasks of the next, so
    a deep or lopsided tree keeps all tasks busy and no file index is held on the driver.  Each level is written before
    the next begins; a task that is lost lists its folders again.  A folder that can't be read gives one error row, and the walk goes on.
    Roots are paths that the executors see, or addresses (``hdfs://``, ``s3://``) of stores that pyarrow reads."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/listing-{uuid.uuid4().hex}"
    todo = spark.createDataFrame([(i, r, r) for i, r in enumerate(roots)], "root_ord int, root string, path string")
    level = 0
    while True:
        spread(todo, "path").mapInArrow(lambda b: _entries(b, include_quarantine, quarantine), ENTRY_SCHEMA).write.parquet(f"{base}/level={level}")
        todo = spark.read.schema(ENTRY_SCHEMA).parquet(f"{base}/level={level}").where("kind = 'folder'").select("root_ord", "root", "path")
        if todo.isEmpty():
            break
        level += 1
    return spark.read.schema(ENTRY_SCHEMA).parquet(*[f"{base}/level={k}" for k in range(level + 1)])


def list_files(
    spark: SparkSession, roots: list[str], output_root: str | None = None, include_quarantine: bool = False, quarantine: str = QUARANTINE
) -> DataFrame:
    """(path, root, rel, name, size, modified, ord) of all files below the roots; a path seen twice stays with its first root."""
    return listed(walk(spark, normalise_roots(roots, output_root)[0], include_quarantine, quarantine))


def listed(entries: DataFrame) -> DataFrame:
    return first_listing(entries.where("kind = 'file'").select("path", "root", "root_ord", "size", "modified"))


def unreadable(entries: DataFrame) -> DataFrame:
    """(root, path, error): folders that could not be read, once each."""
    return entries.where("kind = 'error'").groupBy("path").agg(
        F.min_by(F.struct("root", "error"), "root_ord").alias("e")
    ).select("e.root", "path", "e.error")


def first_listing(listed: DataFrame) -> DataFrame:
    """One row per cleaned path: the root that comes first keeps it."""
    cleaned = listed.withColumn("path", clean_path(F.col("path")))
    first = cleaned.groupBy("path").agg(
        F.min(F.struct("root_ord", "root", "size", "modified")).alias("f")
    )
    rel = F.substr("path", F.length("f.root") + 2)
    return first.select(
        "path", F.col("f.root").alias("root"), rel.alias("rel"), basename(F.col("path")).alias("name"),
        F.col("f.size").alias("size"), F.col("f.modified").alias("modified"),
        listing_order(F.col("f.root_ord"), rel).alias("ord"),
    )


def is_secondary_part(name: Column) -> Column:
    part = whole_number(F.regexp_extract(name, rx.jvm(rx.MULTIPART, True), 2))
    return F.coalesce(part > 1, F.lit(False))


def is_library_archive(name: Column) -> Column:
    """``.zip``, or ``.rar`` that is not a later part of a set."""
    ext = extension(name)
    return (ext == ".zip") | ((ext == ".rar") & ~is_secondary_part(name))


def in_quarantine(rel: Column, quarantine: str = QUARANTINE) -> Column:
    return F.substring_index(rel, "/", 1) == quarantine


def without_quarantine(files: DataFrame, quarantine: str = QUARANTINE) -> DataFrame:
    """Skips every folder of that name at any depth, as a walk that does not enter it."""
    return files.where(~F.concat(F.lit("/"), "rel").contains(f"/{quarantine}/"))


def inbox(files: DataFrame) -> DataFrame:
    """Archives directly in the root; later RAR parts belong to their first part."""
    return files.where(~F.col("rel").contains("/") & is_library_archive(F.col("name")))


def folders(files: DataFrame) -> DataFrame:
    """(root, folder): every folder that holds a file at any depth."""
    parts = F.split("rel", "/")
    paths = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return (
        files.where(F.col("rel").contains("/")).select("root", F.explode(paths).alias("folder")).distinct()
    )


def empty_folders(before: DataFrame, after: DataFrame, quarantine: str = QUARANTINE) -> DataFrame:
    """Folders that held a file before and hold none afterwards, quarantine left alone."""
    return folders(before).exceptAll(folders(after)).where(
        ~F.concat(F.lit("/"), "folder", F.lit("/")).contains(f"/{quarantine}")
    )
