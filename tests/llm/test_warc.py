import base64
import gzip
import hashlib
import glob

from pyspark.sql import functions as F

from shelfmark.llm import queries, warc
from shelfmark.llm.common import shared_folder

CUT = "\r\n\r\nWARC/1."
SCHEMA = "page_id long, url string, html string, key string, copy int, id string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, "x") for r in rows], SCHEMA)


def read(spark, df, at_least=0):
    path = warc.write(df, shared_folder(spark, "warc-test"), at_least)
    rows = warc.records(spark, path)
    return path, rows, [r.asDict(True) for r in warc.captures(rows).withColumn("page_id", warc.page_id_of(F.col("metadata"))).collect()]


def brute(rows, at_least=0):
    """(page_id, bytes, digest, kind, page of the response) of each row, by plain Python."""
    least = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    classes = {}
    for n, r in enumerate(rows):
        classes.setdefault((r[2] or "").encode(), []).append((least(r), n))
    out = []
    for n, r in enumerate(rows):
        payload = (r[2] or "").encode()
        first = rows[max(classes[payload])[1]]
        alone = len(payload) < at_least or max(classes[payload])[1] == n
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((r[0], len(payload), digest, "response" if alone else "revisit", None if alone else first[0]))
    return out


ROWS = [
    (1, "http://a.example/x?q#f", "<p>é</p>"), (2, "https://b.example", "<p>é</p>"), (2, "https://b.example", "<p>é</p>"), (3, None, None),
    (None, "line\r\nend ^2 ^", ""), (None, None, ""), (5, "http://c/", f"x{CUT}1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc{CUT}0\r\n"),
    (6, "no address", "z" * 300_000), (7, "http://d/", "\r\n\r"), (8, "http://e/", CUT), (9, "http://f/", "\r\n\r\n\r\n"), (-4, "http://g/", "\x00\n"),
]


def assembled(caps):
    """Like brute(): a revisit takes its bytes and page from the response that it refers to."""
    by_id = {c["capture_id"]: c for c in caps}
    out = []
    for c in caps:
        first = by_id[c["response"]["refers_to"]] if c["type"] == "revisit" else c
        r = first["response"]
        out.append((c["page_id"], r["payload_bytes"], r["payload_digest"], c["type"], first["page_id"] if c["type"] == "revisit" else None))
        assert c["response"]["stated_digest"] == r["payload_digest"] and (c["n_requests"], c["n_metadata"]) == (1, 1)
        assert not c["response"]["truncated"] and c["request"]["http_head"].startswith("GET /")
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_round_trip_beside_brute_force(spark):
    path, _, caps = read(spark, pages(spark, ROWS))
    assert order(assembled(caps)) == order(brute(ROWS))
    assert order((c["page_id"], c["target"]) for c in caps) == order(r[:2] for r in ROWS)
    texts = {c["page_id"]: bytes(c["response"]["payload"]).decode() for c in caps if c["type"] == "response" and c["page_id"]}
    assert all(texts[r[0]] == (r[2] or "") for r in ROWS if r[0] in texts)
    # The files are WARC files: a plain reader that goes by Content-Length gets as many records.
    n = 0
    for f in glob.glob(f"{path}/*.gz"):
        data = gzip.open(f).read()
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(head.rsplit(b"Content-Length: ", 1)[1])
            assert data[size : size + 4] == b"\r\n\r\n"
            data, n = data[size + 4 :], n + 1
    assert n == 3 * len(ROWS)


def test_at_least_and_delimiters_at_every_place(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 2 else "s") for i in range(6)]
    _, _, caps = read(spark, pages(spark, rows), at_least=4)
    assert order(assembled(caps)) == order(brute(rows, at_least=4))
    rows = [(i, "u", "a" * (65_536 - 700 + 23 * i) + "\r\n\r" + CUT[: i % 12] + "b" * (i % 3)) for i in range(60)]
    rows += [(100 + i, "http://h/u", "c" * (i % 71) + "\r\n\r\n\r"[: i % 6]) for i in range(4000)]  # record ends at any place of a buffer
    _, _, caps = read(spark, pages(spark, rows).coalesce(1))
    assert order(assembled(caps)) == order(brute(rows))


def test_hot_copies_of_one_row(spark):
    rows = [(1, "http://a/", "same page")] * 300 + [(2, "http://a/", "other")] * 2 + [(i, "http://a/", f"page {i}") for i in range(3, 60)]
    _, _, caps = read(spark, pages(spark, rows))
    assert order(assembled(caps)) == order(brute(rows))
    assert len({c["capture_id"] for c in caps}) == len(rows)


def test_empty_table(spark):
    _, rows, caps = read(spark, pages(spark, ROWS).limit(0))
    assert caps == [] and rows.count() == 0


def record(kind, rid, to=(), body="", extra=""):
    links = "".join(f"WARC-Concurrent-To: {t}\r\n" for t in to)
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n{links}{extra}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


def test_foreign_archive(spark, tmp_path):
    """Links from the response, over another record, several companions, an orphan, a cut-off record; plain file in several splits."""
    http = "Content-Type: application/http; msgtype=response\r\n"
    parts = [
        record("warcinfo", "<w>", body="software: x"), record("response", "<a>", ["<q1>"], "HTTP/1.1 200 OK\r\n\r\nhello", http), record("request", "<q1>", [], "GET / HTTP/1.1\r\n\r\n"),
        record("metadata", "<m1>", ["<q1>"], "via: x"), record("metadata", "<m0>", ["<a>"], "via: y"), record("request", "<lost>", ["<gone>"], "GET"),
        record("response", "<b>", [], "HTTP/1.1 200 OK\r\n\r\n" + "long " * 200_000, http), record("request", "<q2>", ["<b>"], "GET /b"),
    ]
    (tmp_path / "x.warc").write_bytes("".join(parts).encode() + b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <cut>\r\nContent-Length: 99\r\n\r\nonly this")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = warc.records(spark, str(tmp_path))
        caps = {r["capture_id"]: r for r in warc.captures(rows).collect()}
        truncated = [r["id"] for r in rows.where("truncated").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(caps) == {"<a>", "<b>", "<lost>", "<cut>"} and truncated == ["<cut>"]
    assert bytes(caps["<a>"]["response"]["payload"]) == b"hello" and caps["<b>"]["response"]["payload_bytes"] == 1_000_000
    assert (caps["<a>"]["request"]["id"], caps["<a>"]["metadata"]["id"], caps["<a>"]["n_metadata"]) == ("<q1>", "<m0>", 2)
    assert caps["<b>"]["request"]["id"] == "<q2>" and caps["<lost>"]["response"] is None and caps["<lost>"]["n_requests"] == 1


def test_query_on_a_small_folder(spark, tmp_path):
    pages(spark, ROWS).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op11_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert order(map(tuple, got)) == order(brute(ROWS))
