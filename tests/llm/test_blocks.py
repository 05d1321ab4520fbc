from shelfmark.llm import decontaminate


def test_each_block_is_written_before_the_next(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two three"), (2, "five six"), (3, "seven")], "item_id long, text string")
    found = decontaminate.contamination(docs, bench, block_words=2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = {r.doc_id: (r._spans, r._items) for r in found.collect()}
    assert rows == {1: ([[1, 3], [4, 6]], ["1", "2"]), 2: ([], [])}
