"""The chunk store: content ids, keep-first deduplication, append, manifest, and the ledger of files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_id
from tessera.functions.vectors import l2_normalise
from tessera.sources import shared


def keep_first(docs: DataFrame, text: str = "page_content", order: str = "doc_idx") -> DataFrame:
    """One row of each text, the first by ``order``, with its doc_id; aggregated before texts move."""
    hashed = docs.withColumn("doc_id", content_id(text))
    first = hashed.groupBy("doc_id").agg(F.min(order).alias(order))
    return hashed.join(first, ["doc_id", order], "left_semi")


def new_rows(docs: DataFrame, store: DataFrame | None, text: str = "page_content", order: str = "doc_idx") -> DataFrame:
    """Rows of keep_first() whose content the store doesn't hold."""
    found = keep_first(docs, text, order)
    return found if store is None else found.join(store.select("doc_id"), "doc_id", "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the manifest is there; it is written last."""
    return shared.exists(spark, f"{path}/manifest")


def load(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/rows") if exists(spark, path) else None


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first().value)


def needs_rebuild(spark: SparkSession, path: str, **wanted) -> bool:
    """Whether the manifest is missing or differs in any of ``wanted``."""
    return not exists(spark, path) or any(manifest(spark, path).get(k) != v for k, v in wanted.items())


def add(spark: SparkSession, docs: DataFrame, path: str, normalise: bool = True, recreate: bool = False, order: str = "doc_idx", **about) -> int:
    """Append new rows (``page_content``, ``embedding`` if any, others) and return how many; then write the manifest."""
    if "embedding" in docs.columns:
        missing = docs.where(F.col("embedding").isNull() != F.col("page_content").isNull()).limit(1).count()
        if missing:
            raise ValueError("documents and embeddings don't match in number")
        docs = docs.withColumn("embedding", F.col("embedding").cast("array<float>"))
    before = None if recreate else load(spark, path)
    rows = new_rows(docs, before, order=order)
    if normalise and "embedding" in rows.columns:
        rows = rows.withColumn("embedding", l2_normalise(F.col("embedding")).cast("array<float>"))
    had = before.count() if before is not None else 0
    rows.write.mode("overwrite" if before is None else "append").parquet(f"{path}/rows")
    count = spark.read.parquet(f"{path}/rows").count()
    line = json.dumps({"count": count, "normalized": normalise, **about}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return count - had


def content_ids(docs: DataFrame, text: str = "page_content") -> DataFrame:
    """(doc_id): the ids of all contents."""
    return docs.select(content_id(text).alias("doc_id")).distinct()


def keep_only(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Drop the rows whose content isn't among ``ids(doc_id)``; returns how many are left.  The manifest is away meanwhile and written last."""
    about = manifest(spark, path)
    rows = spark.read.parquet(f"{path}/rows").join(ids, "doc_id", "left_semi")
    shared.remove(spark, f"{path}/next")
    rows.write.parquet(f"{path}/next")
    shared.remove(spark, f"{path}/manifest")
    spark.read.parquet(f"{path}/next").write.mode("overwrite").parquet(f"{path}/rows")
    shared.remove(spark, f"{path}/next")
    count = spark.read.parquet(f"{path}/rows").count()
    spark.createDataFrame([(json.dumps(about | {"count": count}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return count


def ledger_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(name, state): files ``new``, ``changed`` (by sha1), ``same`` or ``removed``; both sides have (name, sha1)."""
    a, b = now.select("name", F.col("sha1").alias("now")), before.select("name", F.col("sha1").alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("was"), "same").otherwise("changed")
    return a.join(b, "name", "full").select("name", state.alias("state"))


def status(docs: DataFrame) -> DataFrame:
    """(source, chunks, pages) with the largest source first."""
    return docs.groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("page_label").alias("pages")).orderBy(F.desc("chunks"), "source")


def length_stats(lengths: DataFrame, column: str = "n", limit: int | None = None) -> DataFrame:
    """One row: least, upper median (by counting, so nothing is gathered), greatest, and how many are over ``limit``."""
    counts = lengths.groupBy(F.col(column).cast("long").alias("n")).agg(F.count("*").alias("c"))
    over = F.sum(F.when(F.col("n") > (limit if limit is not None else 1 << 60), F.col("c")).otherwise(0))
    ends = counts.agg(F.min("n").alias("least"), F.max("n").alias("greatest"), F.sum("c").alias("total"), over.cast("long").alias("n_over"))
    run = F.sum("c").over(Window.orderBy("n"))  # one task, but a row for each distinct length only
    median = counts.withColumn("upto", run).crossJoin(F.broadcast(ends.select("total"))).where(F.expr("upto > total div 2")).agg(F.min("n").alias("upper_median"))
    return ends.crossJoin(F.broadcast(median)).select("least", "upper_median", "greatest", "n_over")
