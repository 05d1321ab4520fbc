import corpus_pipeline
from shelfmark.llm import decontaminate, line_dedup, queries, simhash

from .conftest import ODD
from .test_dedup import brute_components, lines_brute

TINY = "/root/testdata/sf0.001"


def test_stages_take_odd_rows_and_empty_tables(spark, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, TINY)
            rows = out.count()
            if name != "packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert rows <= len(ODD) or name == "packing"


def test_each_stage_does_its_work(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, TINY)
    assert kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in rows(docs))
    lined = stages["lines"](spark, kept, TINY)
    assert sorted(rows(lined)) == sorted((d, t) for d, t, *_ in lines_brute(rows(kept), 10, "none").elements())
    single = stages["near_duplicates"](spark, lined, TINY)
    before = rows(lined)
    assert sorted(d for d, _ in rows(single)) == sorted(set(brute_components(before)))
    clean = stages["benchmark"](spark, single, TINY)
    marked = decontaminate.contamination(single, spark.read.parquet(f"{TINY}/benchmark.parquet"))
    assert clean.count() == marked.where(~decontaminate.contaminated()).count() < single.count()
    packed = stages["packing"](spark, clean, TINY)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {d for d, _ in rows(clean)}


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert list(corpus_pipeline.QUERIES) == ["pipeline"] and len(corpus_pipeline.STAGES) == 5
