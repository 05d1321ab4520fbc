"""Document quality by hierarchical empirical Bayes.

A logistic classifier over simple text measures gives every document a probability of good quality.  Each document
is one trial: its label where it may be learned from, else the classifier's probability.  A document with k distinct
sites (mirrors) is 1/k of that trial at each of them.  Grouped
aggregation counts the trials of every (host, path) and every host; the prior strengths of hosts below the whole
and of paths below hosts come from the spread between groups (ANOVA estimate of a beta prior).  A host's mean
is shrunk toward the whole, a path's toward its host, so a sparse site stays near the global prior.  The
final log odds are the document's plus its path's (the mean of the log odds of its paths), less the whole's; a
document's own trial is taken out of its sites first, so nothing counts twice.

The classifier is fitted on at most ``sample`` labelled documents (a documented bound, chosen by a hash of
doc_id); all counts cover all documents.  A host with a third of all rows is combined before the shuffle,
and the join back to it is one that AQE splits.

Defined cases: NULL and empty texts have the measures of an empty text.  NULL host or path is a site of its
own.  Repeated label rows count once (the worse label).  Without labels of both classes every score is the share of good
labels, or 0.5 where there are none.  Every row is kept; NULL or repeated ids get no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import logistic
from shelfmark.llm.common import fold_of, share_of, small_batches, written

WORD = re.compile(r"[^\W\d_]+")
MEASURES = 10
LEAST, MOST = 1.0, 1e6


def measures(text: str | None) -> list[float]:
    """Shares of letters, capitals, digits, spaces, points and commas, other marks; word length; share of distinct
    words; words a line; log length."""
    text = text or ""
    n = max(1, len(text))
    words = WORD.findall(text)
    letters = sum(map(len, words))
    capitals = sum(map(str.isupper, text))
    digits, spaces, marks = sum(map(str.isdigit, text)), sum(map(str.isspace, text)), text.count(".") + text.count(",")
    w = max(1, len(words))
    return [
        letters / n, capitals / max(1, letters), digits / n, spaces / n, marks / n, (n - letters - digits - spaces - marks) / n,
        letters / w, len({x.lower() for x in words}) / w, np.log1p(w / (1 + text.count("\n"))), np.log1p(len(text)),
    ]


@dataclass
class Model:
    regression: logistic.Logistic | None
    share: float


def _measured(docs: DataFrame, extra: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[extra], pa.array([measures(t) for t in b["text"].to_pylist()], pa.list_(pa.float64()))], [extra, "x"])

    return docs.select(extra, "text").mapInArrow(run, f"{extra} {docs.schema[extra].dataType.simpleString()}, x array<double>")


def trials(labels: DataFrame) -> DataFrame:
    """doc_id, y: the labels that may be learned from, one row for each document."""
    return labels.where((fold_of("doc_id") != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model:
    small_batches(docs.sparkSession)
    known = trials(labels)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Model(None, counts.get(1.0, 0) / total if total else 0.5)
    quota = F.when(F.col("y") == 1, sample / counts[1.0]).otherwise(sample / counts[0.0])
    chosen = F.broadcast(known.where(share_of(F.col("doc_id")) < quota))  # about 2 * sample rows
    rows = _measured(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "y"), "y").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, MEASURES)
    return Model(logistic.fit(x, np.array([r["y"] for r in rows]), counts[1.0] / total), counts[1.0] / total)


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, host, path, p of every row of ``docs`` (doc_id, text, host, path)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            x = np.array([measures(t) for t in b["text"].to_pylist()]).reshape(-1, MEASURES)
            p = logistic.sigmoid(m.regression.logit(x)) if m.regression else np.full(len(x), m.share)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["host"], b["path"], pa.array(p, pa.float64())], ["doc_id", "host", "path", "p"])

    return docs.select("doc_id", "text", "host", "path").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, path string, p double"
    )


def strength(between: float, groups: float, above: float, size: float, g: float) -> float:
    """Pseudo-count of the beta prior, from the weighted squares ``between`` group means, the numbers of groups
    and of groups above them, and the effective size."""
    v = g * (1 - g)
    spread = (between - (groups - above) * v) / size if size > 0 else 0.0
    return MOST if spread <= 0 else float(min(MOST, max(LEAST, v / spread - 1)))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def posteriors(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (doc_id, host, path, p, and optionally sites: further distinct (host, path) that stand for the row
    instead) -> doc_id, score, p (the document alone), host_mean and path_mean (its sites' posteriors) of every row."""
    own = F.array(F.struct("host", "path"))
    if "sites" not in rows.columns:
        rows = rows.withColumn("sites", own)
    filled = F.transform(F.coalesce("sites", own), lambda s: F.struct(
        F.coalesce(s["host"], F.lit("")).alias("host"), F.coalesce(s["path"], F.lit("")).alias("path")
    ))
    seen = written(
        rows.join(trials(labels), "doc_id", "left").select(
            "doc_id", "p", F.coalesce("y", "p").alias("t"), F.array_distinct(filled).alias("sites"), F.monotonically_increasing_id().alias("row")
        ), "quality-evidence",
    )
    # A document of k sites is 1/k of a trial at each, so that it counts once in the whole.
    each = seen.select("row", "p", "t", (1 / F.size("sites")).alias("w"), F.explode("sites").alias("site")).select("row", "p", "t", "w", "site.host", "site.path")
    paths = each.groupBy("host", "path").agg(F.sum("w").alias("pn"), F.sum(F.col("w") * F.col("t")).alias("ps"))
    hosts = paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"))
    sites = written(paths.join(hosts, "host"), "quality-sites")
    tops = sites.select("host", "hn", "hs").distinct()
    whole = tops.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k")).first()
    if not whole["n"]:
        return seen.select("doc_id", F.col("p").alias("score"), "p", F.col("p").alias("host_mean"), F.col("p").alias("path_mean"))
    n, g = whole["n"], min(max(whole["s"] / whole["n"], 1e-6), 1 - 1e-6)
    top = tops.agg(F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - g, 2)).alias("q"), F.sum(F.col("hn") * F.col("hn") / n).alias("c")).first()
    low = sites.agg(
        F.sum(F.col("pn") * F.pow(F.col("ps") / F.col("pn") - F.col("hs") / F.col("hn"), 2)).alias("q"),
        F.sum(F.col("pn") * F.col("pn") / F.col("hn")).alias("c"), F.count("*").alias("k"),
    ).first()
    m_host = strength(top["q"], whole["k"], 1, n - top["c"], g)
    m_path = strength(low["q"], low["k"], whole["k"], n - low["c"], g)

    def scored(placed: DataFrame, host_own: Column, path_own: Column) -> DataFrame:
        """``host_own`` and ``path_own``: the weight of the row's own trial at its host and path."""
        host_mean = (F.col("hs") - host_own * F.col("t") + m_host * g) / (F.greatest(F.col("hn") - host_own, F.lit(0.0)) + m_host)
        path_mean = (F.col("ps") - path_own * F.col("t") + m_path * F.col("host_mean")) / (F.greatest(F.col("pn") - path_own, F.lit(0.0)) + m_path)
        return placed.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean)

    # Most rows have one site; only the others meet again on their row.
    one = scored(
        seen.where(F.size("sites") == 1).select("doc_id", "p", "t", F.col("sites")[0]["host"].alias("host"), F.col("sites")[0]["path"].alias("path")).join(sites, ["host", "path"]),
        F.lit(1.0), F.lit(1.0),
    ).select("doc_id", "p", "host_mean", "path_mean")
    # At a host the row has as many shares of its trial as it has sites there.
    at_host = F.size(F.filter("sites", lambda s: s["host"] == F.col("site.host")))
    several = seen.where(F.size("sites") > 1).withColumn("site", F.explode("sites")).select(
        "row", "doc_id", "p", "t", "site.host", "site.path", (at_host / F.size("sites")).alias("hw"), (1 / F.size("sites")).alias("w")
    )
    several = scored(several.join(sites, ["host", "path"]), F.col("hw"), F.col("w"))
    back = lambda c: 1 / (1 + F.exp(-F.avg(_logit(F.col(c)))))
    more = several.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("p").alias("p"), back("host_mean").alias("host_mean"), back("path_mean").alias("path_mean"))
    both = one.unionByName(more.drop("row"))
    logit = _logit(F.col("p")) + _logit(F.col("path_mean")) - _logit(F.lit(g))
    return both.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"), "p", "host_mean", "path_mean")


def with_sites(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``rows`` (doc_id, host, path, ...) with ``sites``: the distinct (host, first path segment) of all pages whose
    address ends in the document's id.  Where there are any, host and path are those of the first."""
    found = pages.select(
        F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})([.]html)?/?([?#].*)?$', 1) AS bigint)").alias("p_id"),
        F.struct(
            F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)/", 1).alias("path")
        ).alias("site"),
    ).where("p_id IS NOT NULL").groupBy("p_id").agg(F.sort_array(F.collect_set("site")).alias("sites"))
    joined = rows.join(found, F.col("doc_id") == F.col("p_id"), "left")
    first = F.get("sites", F.lit(0))
    return joined.withColumns({"host": F.coalesce(first["host"], "host"), "path": F.coalesce(first["path"], "path")}).drop("p_id")
