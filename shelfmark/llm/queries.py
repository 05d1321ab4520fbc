"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    chat, decontaminate, exact_dedup, hard_negatives, langid, lexical, line_dedup, packing, quality, simhash, token_files,
    toxicity, warc,
)
from shelfmark.llm.common import fold_of, shared_folder, table, written


def tokenizer_file(name: str) -> str:
    """A public vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    return langid.predict(docs, model).select(
        "doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(True)).alias("held_out"), "lang_pred", "score"
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), decontaminate.n_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.deduplicated(docs, min_docs=10, keep="none")
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7 AS conv_id, turn, role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    read = chat.read_back(chat.windows(turns.union(extra), budget=512, history=128))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sites = docs.select("doc_id", "text", F.col("source").cast("string").alias("host"), F.lit("").alias("path"))
    rows = quality.with_sites(quality.evidence(sites, quality.fit(docs, labels)), table(spark, sf_dir, "pages"))
    return quality.posteriors(rows, labels).select(
        "doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("p").alias("document_score"), "host_mean", "path_mean",
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(table(spark, sf_dir, "documents"), distance=3)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.read(spark, token_files.write(docs, tokenizer_file("word_bpe_49k.json"), end_id=2))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=packing.Capacity(tokens=2048))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"), at_least=0)
    # Payloads are measured where they are read; only those of metadata records go on.
    own = F.when(F.col("type") == "metadata", F.col("payload"))
    rows = written(warc.records(spark, path).drop("block").withColumn("payload", own), "warc-records")
    captures = written(warc.captures(rows).select(
        "capture_id", warc.page_id_of(F.col("metadata")).alias("page_id"), F.col("type").alias("record_type"),
        "response.refers_to", "response.payload_bytes", "response.payload_digest",
    ), "warc-captures")
    first = captures.where("record_type = 'response'").select(
        F.col("capture_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"),
    )
    return captures.join(first, "refers_to", "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "_digest").alias("payload_digest"),
        "record_type", F.col("_page").alias("refers_to"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.vectors(table(spark, sf_dir, "embeddings"), shifted, scale=256))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_decontaminate, op3_toxicity, op4_exact_dedup, op5_line_dedup, op6_chat_format, op7_quality,
    op8_simhash, op9_token_files, op10_best_fit_packing, op11_warc,
    op12_hard_negatives, op13_lexical_search,
)}

_OP2 = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS MATERIALIZED (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
phrase AS MATERIALIZED (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
place AS MATERIALIZED (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS p
  FROM w, (SELECT DISTINCT size FROM phrase) AS s, unnest(range(1, len(w) - size + 2)) AS t(i)),
occ AS MATERIALIZED (SELECT doc_id, i, place.size, item_id FROM place JOIN phrase USING (p) WHERE place.size = phrase.size),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM occ, unnest(range(i, i + size)) AS t(k) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items,
  sha256(coalesce(item.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)"""

_OP4 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)"""

_OP5 = r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, i, s[i] AS line, translate(regexp_replace(regexp_replace(s[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS t(i)),
r AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, r.key IS NOT NULL AS gone FROM l LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

_OP6 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(role || '|' || text, chr(92), chr(92) || chr(92)) AS x,
  CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\x20\x09-\x0D\p{L}\p{N}_]')) + 4 AS BIGINT) AS tokens,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM c),
t AS (SELECT *, 32 + length(x) + len(regexp_extract_all(x, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]')) AS chars FROM e),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY k) AS stop, sum(tokens) OVER (PARTITION BY conv_id) AS total FROM t),
y AS (SELECT conv_id, tokens AS sys, chars AS sys_chars FROM s WHERE k = 1 AND role = 'system' AND total > tokens),
n AS (SELECT s.*, stop - tokens AS start, coalesce(sys, 0) AS sys, coalesce(sys_chars, 0) AS sys_chars, greatest(384 - coalesce(sys, 0), 128) AS room
  FROM s LEFT JOIN y USING (conv_id) WHERE k > 1 OR y.sys IS NULL),
b AS (SELECT *, min(start) OVER (PARTITION BY conv_id, (start - sys) // room) AS begin FROM n),
f AS (SELECT *, CASE WHEN stop - begin > room THEN start ELSE begin END AS first FROM b),
w AS (SELECT DISTINCT conv_id, first, sys_chars FROM f),
z AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, sys_chars AS chars FROM w UNION ALL SELECT conv_id, chars FROM f
  UNION ALL SELECT w.conv_id, chars FROM w JOIN f USING (conv_id) WHERE f.first < w.first AND f.start >= w.first - 128) GROUP BY conv_id)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, min(z.chars)::BIGINT AS formatted_chars
FROM s JOIN z USING (conv_id) GROUP BY s.conv_id"""

_OP11 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, upper(sha1(payload)) AS x, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  translate(array_to_string([to_base(CAST('0x' || x[i:i + 9] AS BIGINT), 32, 8) FOR i IN [1, 11, 21, 31]], ''),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d"""

_OP12 = r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.c, v.c) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

_OP13 = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents) WHERE len(w) > 0),
q AS MATERIALIZED (
  SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark)),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
p AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) GROUP BY doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10"""

SQL = {"op2_decontaminate": _OP2, "op4_exact_dedup": _OP4, "op5_line_dedup": _OP5, "op6_chat_format": _OP6, "op11_warc": _OP11, "op12_hard_negatives": _OP12, "op13_lexical_search": _OP13}
