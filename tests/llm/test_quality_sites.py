import math
from collections import defaultdict

import pytest

from shelfmark.llm import quality
from shelfmark.llm.common import fold_of

PAGES = [(0, "https://a.example/x/{}.html"), (1, "https://z.example/y/{}.html"), (2, "https://z.example/w/{}.html")]


def brute_posteriors(rows, marks):
    """{doc_id: (score, host_mean, path_mean)} of rows {doc_id: (p, sites)}."""
    t = {d: marks.get(d, p) for d, (p, _) in rows.items()}
    pn, ps, hn, hs = (defaultdict(float) for _ in range(4))
    for d, (_, sites) in rows.items():
        for host, path in sites:
            w = 1 / len(sites)
            pn[host, path] += w
            ps[host, path] += w * t[d]
            hn[host] += w
            hs[host] += w * t[d]
    n = sum(hn.values())
    g = sum(hs.values()) / n
    top = sum(hn[h] * (hs[h] / hn[h] - g) ** 2 for h in hn)
    low = sum(pn[s] * (ps[s] / pn[s] - hs[s[0]] / hn[s[0]]) ** 2 for s in pn)
    m_host = quality.strength(top, len(hn), 1, n - sum(x * x for x in hn.values()) / n, g)
    m_path = quality.strength(low, len(pn), len(hn), n - sum(pn[s] ** 2 / hn[s[0]] for s in pn), g)
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    back = lambda x: 1 / (1 + math.exp(-x))
    out = {}
    for d, (p, sites) in rows.items():
        hosts, paths = [], []
        for host, path in sites:
            w, hw = 1 / len(sites), sum(h == host for h, _ in sites) / len(sites)
            h = (hs[host] - hw * t[d] + m_host * g) / (hn[host] - hw + m_host)
            hosts.append(h)
            paths.append((ps[host, path] - w * t[d] + m_path * h) / (pn[host, path] - w + m_path))
        host, path = (back(sum(map(logit, x)) / len(x)) if len(x) > 1 else x[0] for x in (hosts, paths))
        out[d] = (back(logit(p) + logit(path) - logit(g)), host, path)
    return out


def test_every_site_of_a_document_counts(spark):
    # Bad documents are mirrored at a.example and z.example, good ones are at a.example only; 900 is at z.example only.
    rows = [(i, "same text.", "own", "") for i in range(200)] + [(900, "same text.", "own", ""), (901, "same text.", "own", "")]
    at = lambda i: [0] if i % 2 else [0, 1, 2] if i % 4 else [0, 1]
    urls = [PAGES[k][1].format(i) for i in range(200) for k in at(i)] + ["https://z.example/y/900.html"] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    model = quality.fit(docs, marks)
    placed = quality.with_sites(quality.evidence(docs, model), pages)
    got = {r.doc_id: r for r in quality.posteriors(placed, marks).collect()}
    assert len(got) == len(rows)
    assert got[900].score < got[901].score
    sites = {i: [(("a.example", "x"), ("z.example", "y"), ("z.example", "w"))[k] for k in at(i)] for i in range(200)} | {900: [("z.example", "y")], 901: [("own", "")]}
    learned = {r.doc_id: float(r.quality) for r in marks.where(fold_of("doc_id") != 0).collect()}
    want = brute_posteriors({d: (got[d].p, s) for d, s in sites.items()}, learned)
    for d, (score, host, path) in want.items():
        assert (got[d].score, got[d].host_mean, got[d].path_mean) == pytest.approx((score, host, path), abs=1e-9)
