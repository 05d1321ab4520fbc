"""Archive member listings: ZIP directories, nested archives included, read in the tasks."""

import posixpath

from pyspark.sql import DataFrame

from shelfmark.functions import fixed_values as fv

ENTRY_SCHEMA = (
    "archive string, depth int, ordinal bigint, name string, logical string, is_dir boolean, is_link boolean, "
    "size bigint, error string"
)


def _walk(handle, archive, prefix, depth, counter):
    """Yields the entries of one ZIP and of the ZIPs inside it, in directory order.  A broken
    nested archive keeps its own entry and adds an error row."""
    import tempfile
    import zipfile

    with zipfile.ZipFile(handle) as z:
        infos = z.infolist()
        files = [i for i in infos if not i.is_dir()]
        # A wrapper whose only file is an archive adds no folder of its own.
        transparent = len(files) == 1 and posixpath.splitext(files[0].filename)[1].lower() in fv.ARCHIVE_LIKE_EXTENSIONS
        for info in infos:
            link = (info.external_attr >> 16) & 0o170000 == 0o120000
            logical = posixpath.join(prefix, info.filename)
            yield archive, depth, next(counter), info.filename, logical, info.is_dir(), link, info.file_size, None
            stem, ext = posixpath.splitext(info.filename)
            if info.is_dir() or link or ext.lower() not in (".zip", ".cbz"):
                continue
            if depth >= fv.MAX_DEPTH:
                yield archive, depth + 1, next(counter), "", logical, False, False, 0, "nested archive depth exceeds limit"
                continue
            child = posixpath.join(prefix, posixpath.dirname(info.filename) if transparent else stem)
            try:
                with tempfile.TemporaryFile() as spool, z.open(info) as src:
                    while chunk := src.read(1 << 20):
                        spool.write(chunk)
                    yield from _walk(spool, archive, child, depth + 1, counter)
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as e:
                yield archive, depth + 1, next(counter), "", logical, False, False, 0, str(e)


def list_members(archives: DataFrame) -> DataFrame:
    """Entries of every ZIP/CBZ.  ``archives`` has ``archive`` and either ``path`` (a mounted
    file, opened in the task) or ``content`` (bytes, as the ``binaryFile`` source gives them)."""
    by_content = "content" in archives.columns

    def read(batches):
        import io
        import itertools
        import zipfile

        import pandas as pd

        columns = [f.split()[0] for f in ENTRY_SCHEMA.split(", ")]
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                counter = itertools.count()
                source = io.BytesIO(row.content) if by_content else row.path
                rows = []
                try:
                    for entry in _walk(source, row.archive, "", 0, counter):
                        rows.append(entry)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except (zipfile.BadZipFile, OSError) as e:
                    rows.append((row.archive, 0, next(counter), "", "", False, False, 0, str(e)))
                yield pd.DataFrame(rows, columns=columns)

    keep = archives.select("archive", "content" if by_content else "path")
    return keep.mapInPandas(read, ENTRY_SCHEMA)
