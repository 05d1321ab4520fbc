"""WARC archives: records written from pages, read back, and assembled to one nested row for each capture.

``write`` makes a request, a response (or revisit) and a metadata record of every page; request and metadata name the
response in WARC-Concurrent-To.  The records are rows of Spark's text writer with the blank line that ends a record as
line end, so the files are plain gzip WARC files that any tool reads.  ``records`` reads any WARC files by the text
reader, cut at the blank line before ``WARC/1.``: large plain files are split, gzip files are one task each.  A payload may hold that
very text; then the pieces of its file are put together by Content-Length in file order (one record in memory at a time).
``captures`` joins request and metadata records to their response through the concurrent-to identifiers, in either
direction and over one record between.

Of pages with equal payloads of at least ``at_least`` bytes the one with the largest (page_id, url) is the response, the
others revisit it and carry no payload.  Equal means of one SHA-256.

Defined cases: a NULL html is an empty payload.  A NULL page_id or url is absent from the records and read back as NULL; a
NULL page_id is the least.  Repeated rows are captures of their own, with a copy number in their record ids.  Line ends in
a url are escaped with ``^`` and read back.  An empty table gives archives without records.  Other columns, whatever their names, are not
archived.  A record cut off by the end of its file has ``truncated`` set; a piece without WARC header has no type and is no
capture.  Companions without a response are captures without one.  Of several request or metadata records of one capture
that with the least id is in its row (``n_requests`` and ``n_metadata`` count all); ``attached`` lists every one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import BATCH_BYTES, small_batches, written
from shelfmark.operators.ordered import row_numbers

END = "\r\n\r\n"  # ends a header and a record
#: No part of it begins anew within it: the line reader misses a delimiter whose partial matches overlap at a buffer's end.
CUT = "\r\nWARC/1."
DATE = "1970-01-01T00:00:00Z"

_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits (a SHA-1)."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def escaped(value: Column) -> Column:
    """Without line ends; ``unescaped`` gives the value back."""
    for a, b in (("^", "^0"), ("\r", "^1"), ("\n", "^2")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def unescaped(value: Column) -> Column:
    for a, b in (("^2", "\n"), ("^1", "\r"), ("^0", "^")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def _record_id(kind: str, row: Column) -> Column:
    x = F.md5(F.concat(F.lit(kind), F.to_json(row)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(x, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _lines(fields: dict[str, Column]) -> Column:
    """``Name: value`` lines; a NULL value has none."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n")), F.lit("")) for k, v in fields.items()])


def _record(kind: Column, fields: dict[str, Column], block: Column) -> Column:
    head = _lines({"WARC-Type": kind, "WARC-Date": F.lit(DATE), **fields, "Content-Length": F.octet_length(block)})
    return F.concat(F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n")).cast("binary"), block).cast("string")


def decided(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """(page_id, url, payload, key, copy, top): ``top`` is (page_id, url, copy) of the response of a row's class, NULL
    where the row has no equals."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    same = written(
        rows.groupBy("key", "page_id", "url").agg(F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("size")), "warc-keys"
    )
    top = F.max(F.struct("page_id", "url", F.col("n").alias("copy"))).alias("top")
    classes = same.where(F.col("size") >= at_least).groupBy("key").agg(F.sum("n").alias("n"), top).where("n > 1").drop("n")
    repeated = same.where("n > 1").select("key", F.col("page_id").alias("_p"), F.col("url").alias("_u"))
    if repeated.isEmpty():
        rows = rows.withColumn("copy", F.lit(1).cast("long"))
    else:
        on = (rows["key"] == repeated["key"]) & rows["page_id"].eqNullSafe(F.col("_p")) & rows["url"].eqNullSafe(F.col("_u"))
        once = rows.join(repeated, on, "left_anti").withColumn("copy", F.lit(1).cast("long"))
        again = rows.join(repeated, on, "left_semi").withColumn("_at", F.monotonically_increasing_id())
        again = row_numbers(again, ["key", "page_id", "url"], [F.col("_at")], "copy").drop("_at")
        rows = once.unionByName(again.withColumn("copy", F.col("copy").cast("long")))
    return rows.join(classes, "key", "left")


def write(pages: DataFrame, path: str, at_least: int = 0) -> str:
    """Archives every row of ``pages`` below ``path``."""
    own = F.struct("page_id", "url", "copy")
    is_top = F.col("top").isNull() | own.eqNullSafe(F.col("top"))
    identity = lambda x: F.struct("key", x["page_id"].alias("page_id"), x["url"].alias("url"), x["copy"].alias("copy"))
    rows = decided(pages, at_least).withColumns({
        "_first": is_top, "_id": _record_id("response", identity(own)), "_target": escaped(F.col("url")),
        "_digest": F.concat(F.lit("sha1:"), base32(F.sha1("payload"))),
    })
    place = F.regexp_extract("_target", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    request = F.concat(
        F.lit("GET "), F.when(F.startswith(place, F.lit("/")), place).otherwise(F.concat(F.lit("/"), place)), F.lit(" HTTP/1.1\r\nHost: "),
        F.regexp_extract("_target", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(END),
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END)
    ).cast("binary")
    block = F.when(F.col("_first"), F.concat(http, F.col("payload"))).otherwise(http)
    profile = F.when(~F.col("_first"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    refers = F.when(~F.col("_first"), _record_id("response", identity(F.col("top"))))
    shared = {"WARC-Concurrent-To": F.col("_id"), "WARC-Target-URI": F.col("_target")}
    three = F.array(
        _record(F.lit("request"), {"WARC-Record-ID": _record_id("request", identity(own)), **shared, "Content-Type": F.lit("application/http; msgtype=request")}, F.coalesce(request, F.lit("GET / HTTP/1.1" + END)).cast("binary")),
        _record(
            F.when(F.col("_first"), "response").otherwise("revisit"),
            {"WARC-Record-ID": F.col("_id"), "WARC-Target-URI": F.col("_target"), "WARC-Payload-Digest": F.col("_digest"), "WARC-Profile": profile, "WARC-Refers-To": refers, "Content-Type": F.lit("application/http; msgtype=response")},
            block,
        ),
        _record(F.lit("metadata"), {"WARC-Record-ID": _record_id("metadata", identity(own)), **shared, "Content-Type": F.lit("application/warc-fields")}, _lines({"page_id": F.col("page_id")}).cast("binary")),
    )
    rows.select(F.explode(three).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in file order, put together until a record has its Content-Length."""
    out, size = [], 0
    part: list[bytes] = []
    have = need = 0
    file = None

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    for b in batches:
        for f, v in zip(b["file"].to_pylist(), b["value"].to_pylist()):
            if part and f == file:
                part += [CUT.encode(), v]
                have += len(CUT) + len(v)
            else:
                if part:
                    out.append(b"".join(part))
                head = v.split(END.encode(), 1)[0]
                found = _LENGTH.search(head)
                part, have, need, file = [v], len(v), len(head) + len(END) + int(found[1]) if found else 0, f
            if have >= need:
                out.append(b"".join(part))
                size += have
                part = []
                if size >= BATCH_BYTES:
                    yield flushed()
                    out, size = [], 0
    if part:
        out.append(b"".join(part))
    yield flushed()


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("_head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the WARC files at ``path``."""
    small_batches(spark)
    pieces = spark.read.option("lineSep", CUT).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    head = F.substring_index("value", END, 1)
    claimed = F.octet_length(head) + len(END) + F.regexp_extract(head, r"(?i)\r\ncontent-length:[ \t]*(\d+)", 1).try_cast("long")
    broken = pieces.where(F.coalesce(F.octet_length("value") < claimed, F.lit(True))).select("file").distinct()
    whole = pieces.select("value")
    if not broken.isEmpty():
        # A file holds at most what one task reads of it in order; other files keep the plain way.
        parts = pieces.join(broken, "file", "left_semi").select("file", "block", "seq", F.col("value").cast("binary").alias("value"))
        mended = parts.repartition("file").sortWithinPartitions("file", "block", "seq").mapInArrow(_mended, "value binary")
        whole = pieces.join(broken, "file", "left_anti").select("value").union(mended.select(F.col("value").cast("string")))
    length = _header("Content-Length").try_cast("long")
    block = F.substring(F.col("value").cast("binary"), F.octet_length("_head") + len(END) + 1, F.col("_length").cast("int"))
    http = F.col("content_type").startswith("application/http")
    http_head = F.substring_index(F.col("block").cast("string"), END, 1)
    has_body = http & F.col("type").isin("response", "request")
    return (
        whole.withColumn("_head", F.substring_index("value", END, 1))
        .withColumns({
            "id": _header("WARC-Record-ID"), "type": F.lower(_header("WARC-Type")), "date": _header("WARC-Date"),
            "target": unescaped(_header("WARC-Target-URI")), "content_type": _header("Content-Type"), "refers_to": _header("WARC-Refers-To"),
            "stated_digest": F.regexp_replace(_header("WARC-Payload-Digest"), "^(?i)sha1:", ""),
            "concurrent": F.regexp_extract_all("_head", F.lit(r"(?i)\r\nWARC-Concurrent-To:[ \t]*([^\r\n]*)"), F.lit(1)), "_length": length,
        })
        .withColumn("block", block)
        .withColumn("truncated", F.octet_length("block") < F.col("_length"))
        .withColumn("http_head", F.when(http, http_head))
        .withColumn("payload", F.when(has_body, F.substring("block", F.octet_length("http_head") + len(END) + 1, F.octet_length("block"))).when(~http, F.col("block")))
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("payload_digest", base32(F.sha1("payload")))
        .drop("value", "_head", "_length")
    )


ANCHORS = ("response", "revisit", "resource")


def attached(rows: DataFrame) -> DataFrame:
    """(id, capture_id) of the request, metadata and other records that belong to a response, revisit or resource."""
    links = rows.select("id", "type", F.explode("concurrent").alias("other"))
    both = links.select("id", "other").union(links.select(F.col("other").alias("id"), F.col("id").alias("other"))).where("id <> other")
    anchors = rows.where(F.col("type").isin(*ANCHORS)).select(F.col("id").alias("other")).distinct()
    companions = both.join(anchors.select(F.col("other").alias("id")), "id", "left_anti")
    near = companions.join(anchors, "other").groupBy("id").agg(F.min("other").alias("capture_id"))
    lost = companions.join(near.select("id"), "id", "left_anti")
    far = lost.join(near.select(F.col("id").alias("other"), "capture_id"), "other").groupBy("id").agg(F.min("capture_id").alias("capture_id"))
    return near.unionByName(far)


_SHOWN = ("id", "date", "http_head", "payload", "payload_bytes", "payload_digest", "stated_digest", "refers_to", "truncated")


def captures(rows: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, type, target, response, request, metadata, n_requests, n_metadata."""
    shown = F.struct(*_SHOWN)
    anchors = rows.where(F.col("type").isin(*ANCHORS)).select(F.col("id").alias("capture_id"), "type", "target", shown.alias("response"))
    others = rows.where(F.col("type").isNotNull() & ~F.col("type").isin(*ANCHORS, "warcinfo"))
    others = others.join(attached(rows), "id", "left").withColumn("_shown", shown)
    is_request, is_meta = F.col("type") == "request", F.col("type") == "metadata"
    grouped = others.groupBy(F.coalesce("capture_id", "id").alias("capture_id")).agg(
        F.min_by(F.when(is_request, F.col("_shown")), F.when(is_request, F.col("id"))).alias("request"),
        F.min_by(F.when(is_meta, F.col("_shown")), F.when(is_meta, F.col("id"))).alias("metadata"),
        F.count_if(is_request).alias("n_requests"), F.count_if(is_meta).alias("n_metadata"), F.min("target").alias("_target"),
    )
    out = anchors.join(grouped, "capture_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(
        "capture_id", "type", F.coalesce("target", "_target").alias("target"), "response", "request", "metadata", zero("n_requests"), zero("n_metadata")
    )


def page_id_of(metadata: Column) -> Column:
    """The page_id that ``write`` put into the metadata record."""
    return F.regexp_extract(metadata["payload"].cast("string"), r"(?:^|\r\n)page_id: (-?\d+)\r\n", 1).try_cast("long")
