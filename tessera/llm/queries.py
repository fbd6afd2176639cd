"""The operators bound to the benchmark tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import caps, chat, decontam, html_crf, licenses, mixing, quality, simhash, suffix, toxicity
from tessera.llm.common import crc_fold


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def _predicted(found: DataFrame, threshold: float) -> DataFrame:
    return found.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, _read(spark, sf_dir, "labels"))
    return _predicted(toxicity.score(documents, model), 0.5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")), 0.3)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(_read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no file names; their source, language and id stand for one."""
    files = _read(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    return licenses.scan(files, keep=["doc_id", "path"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_read(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parts = mixing.mix(_read(spark, sf_dir, "documents"))
    return parts.select("doc_id", "size", "source_size", "target", "taken")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup_substrings(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL_OP2 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95
), reach AS (
  WITH RECURSIVE r(node, low) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.low FROM r JOIN pairs p ON p.a = r.node WHERE r.low < p.b
  ) SELECT node, min(low) AS low FROM r GROUP BY node
), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept
FROM v LEFT JOIN n ON n.a = vec_id JOIN reach ON node = vec_id
"""

SQL_OP8 = """
WITH people AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
m AS (
  SELECT c.conv_id, perspective, turn, coalesce(role = perspective, false) AS mask, coalesce(role = 'system', false) AS fixed, role, coalesce(text, '') AS t, text IS NULL AS untold
  FROM conversations c JOIN people p ON c.conv_id IS NOT DISTINCT FROM p.conv_id
), h AS (
  SELECT *, CASE WHEN mask THEN 'assistant' WHEN fixed THEN role ELSE 'user' END AS chat_role, CASE WHEN NOT mask AND NOT fixed THEN role END AS name FROM m
), s AS (SELECT *, '<|' || chat_role || coalesce(' name=' || name, '') || '|>' || chr(10) AS head FROM h),
g AS (SELECT *, head || t || chr(10) || '<|end|>' || chr(10) AS segment FROM s),
w AS (
  SELECT *, row_number() OVER o AS seq, (sum(length(segment)) OVER (o ROWS UNBOUNDED PRECEDING) - length(segment) + length(head))::BIGINT AS from_char
  FROM g WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role NULLS LAST, untold, t)
)
SELECT conv_id, perspective, seq, turn, chat_role, name, segment, mask, from_char, (from_char + length(t))::BIGINT AS to_char FROM w
"""

SQL_OP7 = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), widths AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, widths WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n
), cover AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES = {"pipeline": corpus_pipeline.run, "op1_simhash": op1_simhash, "op2_cap_filters": op2_cap_filters, "op3_mixing": op3_mixing, "op4_toxicity": op4_toxicity, "op5_html_extraction": op5_html_extraction, "op6_licenses": op6_licenses, "op7_decontamination": op7_decontamination, "op8_perspectives": op8_perspectives, "op9_suffix_array": op9_suffix_array, "op10_quality": op10_quality}
ORACLE = {"op2_cap_filters": SQL_OP2, "op8_perspectives": SQL_OP8, "op7_decontamination": SQL_OP7}
