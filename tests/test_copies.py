import os
from hashlib import sha256

from shelfmark.operators import events as E
from shelfmark.operators.copies import staged_hashes
from shelfmark.sources import listing as L
from shelfmark.sources.logs import log_files
from pyspark.sql import functions as F


def test_only_what_can_be_a_copy_is_read(spark, tmp_path):
    contents = {"a": b"x" * 10, "b": b"x" * 10, "c": b"y" * 10, "d": b"z" * 11, "e": b"h" * 8 + b"1" * 92, "f": b"h" * 8 + b"2" * 92, "g": b"i" * 100, "h": b"", "i": b""}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    rows = [(f"{tmp_path}/{n}", len(d)) for n, d in contents.items()] + [(f"{tmp_path}/gone", 11), (f"{tmp_path}/unknown", None)]
    got = {os.path.basename(r["path"]): (r["sha256"], r["bytes_read"]) for r in staged_hashes(spark.createDataFrame(rows, "path string, size bigint"), block=8).collect()}
    full = {n: sha256(d).hexdigest() for n, d in contents.items()}
    assert got == {
        "a": (full["a"], 18), "b": (full["b"], 18), "c": (None, 8), "d": (None, 8), "e": (full["e"], 108), "f": (full["f"], 108), "g": (None, 8),
        "h": (full["h"], 0), "i": (full["i"], 0), "gone": (None, 0), "unknown": (None, 0),
    }


def test_copies_agree_in_further_columns(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_bytes(b"same")
    df = spark.createDataFrame([(f"{tmp_path}/{n}", 4, w) for n, w in (("a", "w1"), ("b", "w1"), ("c", "w2"))], "path string, size bigint, work string")
    got = {os.path.basename(r["path"]): r["bytes_read"] for r in staged_hashes(df, ["work"]).collect()}
    assert got == {"a": 4, "b": 4, "c": 0}


def test_log_files_by_metadata_alone(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k, name in enumerate(("old.jsonl", "d/new.jsonl", "d/other.txt")):
        (tmp_path / name).write_bytes(b"{}\n" * (k + 1))
        os.utime(tmp_path / name, (1_700_000_000 + 86_400 * 20 * k,) * 2)
    logs = log_files(spark, str(tmp_path))
    assert {(r["job_id"], r["size_bytes"]) for r in logs.collect()} == {("old", 3), ("new", 6)}
    now = F.timestamp_seconds(F.lit(1_700_000_000 + 86_400 * 30))
    assert [r["job_id"] for r in E.retention_expired(logs, now).collect()] == ["old"]
    assert [r["job_id"] for r in E.latest_logs(logs, 1).collect()] == ["new"]
    assert L.unreadable(L.walk(spark, [str(tmp_path)])).count() == 0


def test_redaction_stops_at_its_depth(spark):
    text = '{"a":{"token":1,"b":{"path":2}},"list":[{"token":3}],"c":null}'
    df = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", "map<string,variant>").alias("f"))
    out = [df.select(F.to_json(E.redacted(F.col("f"), depth=d))).first()[0] for d in (1, 2, 3)]
    assert out == [
        '{"a":{"b":{"path":2},"token":1},"list":[{"token":3}],"c":null}', '{"a":{"b":{"path":2},"token":"[REDACTED]"},"list":[{"token":3}],"c":null}',
        '{"a":{"b":{"path":"[REDACTED_PATH]"},"token":"[REDACTED]"},"list":[{"token":3}],"c":null}',
    ]
