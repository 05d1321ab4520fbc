"""The corpus pipeline: raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
rereads it as the next stage's ``docs``.  All but the last return the columns of ``docs``.

1. language: documents of language ``und`` go, those without a letter (all, if nothing was learned).  No least score
   is set, so text of a language that was never learned stays.
2. lines: lines that 10 or more documents have are taken out of every text; ``n_chars`` follows the text.
3. near duplicates: one document of each SimHash component stays.
4. benchmark: contaminated documents go.
5. packing: the rest becomes sequences of at most 2048 tokens.

Every stage is defined for NULLs in any column, empty and very long texts, repeated rows, empty tables and extra
columns as its operator is (see the modules in shelfmark/llm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, langid, line_dedup, packing, simhash
from shelfmark.llm.common import discard, guarded, table, written
from shelfmark.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(langid.training_rows(docs)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def run(docs: DataFrame) -> DataFrame:
        out = line_dedup.deduplicated(docs, min_docs=10, keep="none")
        if "n_chars" in docs.columns:
            kind = docs.schema["n_chars"].dataType
            length = F.when(F.col("_n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
            out = out.withColumn("n_chars", length)
        return out

    return guarded(docs, ["_n_lines", "_n_dropped", "_drop"], run)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs, distance=3)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=packing.Capacity(tokens=2048))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", packed),
]

#: Word models, XXH64 and tokenizers are beyond SQL.  tests/llm/test_queries.py holds ``run`` against plain Python, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # the next stage reads its own input alone
        docs = done
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
