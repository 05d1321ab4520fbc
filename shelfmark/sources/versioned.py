"""A keyed table in a shared folder that changes by whole commits.

Rows lie in buckets by the hash of their key.  A commit writes new files for the buckets it touches and then, as its last
step, a version file that names the files of every bucket; the file system refuses to create a version that exists.  Until then
readers see the version before, so a commit that fails halfway leaves unused files and nothing else.  Every version
keeps the id of its commit: a stream that runs a batch again after a failure finds the batch done.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """``schema`` (DDL) with a non-NULL, unique string column ``key``.  Choose ``buckets`` so that one bucket's rows fit a task."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # --- versions -----------------------------------------------------------------------------
    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("versions")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _state(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "commit": None, "files": {}}
        version = known[-1] if version is None else version
        stream = self._fs.open(self._at(f"versions/{version:010d}.json"))
        try:
            return {"version": version, **json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))}
        finally:
            stream.close()

    def _publish(self, version: int, commit: int | None, files: dict[str, str]) -> None:
        """The version file appears complete or not at all: it is written aside and renamed to a name that is still free."""
        self._fs.mkdirs(self._at("versions"))
        aside, final = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{version:010d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"commit": commit, "files": files}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer")

    def last_commit(self) -> int | None:
        return self._state()["commit"]

    # --- rows ---------------------------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._state(version)["files"].values())

    def _rows(self, folders) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, commit: int | None = None) -> bool:
        """Puts ``changes`` (one row a key) in the place of the rows with their keys.  False if ``commit`` was already done:
        ids of commits grow."""
        state = self._state()
        if commit is not None and state["commit"] is not None and commit <= state["commit"]:
            return False
        changes = changes.select(*self.spark.createDataFrame([], self.schema).columns)
        touched = [r[0] for r in changes.select(self.bucket()).distinct().collect()]  # at most ``buckets`` numbers
        files, kept = dict(state["files"]), commit if commit is not None else state["commit"]
        if touched:
            before = self._rows(f for k, f in files.items() if int(k) in touched)
            rows = before.join(changes.select(self.key), self.key, "left_anti").select(*changes.columns).unionByName(changes)
            folder = f"data/{uuid.uuid4().hex}"
            rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            files |= {str(k): f"{folder}/_bucket={k}" for k in touched}
        self._publish(state["version"] + 1, kept, files)
        return True

    def vacuum(self, keep: int = 10) -> int:
        """Removes version files but the last ``keep``, and the folders of rows that no kept version names.  Not while a commit runs."""
        known = self.versions()
        used = {f.split("/")[1] for v in known[-keep:] for f in self._state(v)["files"].values()}
        gone = 0
        if self._fs.exists(self._at("data")):
            for s in self._fs.listStatus(self._at("data")):
                if s.getPath().getName() not in used:
                    gone += bool(self._fs.delete(s.getPath(), True))
        for v in known[:-keep]:
            self._fs.delete(self._at(f"versions/{v:010d}.json"), False)
        return gone
