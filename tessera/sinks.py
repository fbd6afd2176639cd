"""Results written out: evaluation reports, caches of replies, benchmark tables, a legacy index, the log."""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import shared


def logger(name: str = "tessera", level: str = "INFO") -> logging.Logger:
    """A logger to standard output with time, name and level; asking again gives the same one."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
    return log


def save_report(path: str, summary: DataFrame, per_question: DataFrame, by_type: DataFrame | None = None) -> None:
    """A JSON file ``{"summary", "by_type" (if any), "per_question"}``: one row of numbers and a row a question of a stated question set."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    body = {"summary": rows(summary)[0], **({"by_type": rows(by_type)} if by_type is not None else {}), "per_question": rows(per_question.orderBy("question_id"))}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(body, ensure_ascii=False, indent=1), "utf-8")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a cache of replies; empty if there is none."""
    return spark.read.parquet(path) if shared.exists(spark, path) else spark.createDataFrame([], "key string, value string")


def merge_cache(spark: SparkSession, path: str, merged: DataFrame) -> int:
    """Append the replies that the cache lacks; returns how many.  Replies that are there stay as they are."""
    new = merged.where("value is not null").groupBy("key").agg(F.min("value").alias("value")).join(read_cache(spark, path).select("key"), "key", "left_anti")
    had = read_cache(spark, path).count()
    new.write.mode("append").parquet(path)
    return read_cache(spark, path).count() - had


def save_table(path: str, rows: list[dict]) -> str:
    """Benchmark rows as a JSON file, and as a text table for the console."""
    Path(path).write_text(json.dumps(rows, indent=1), "utf-8")
    names = list(rows[0]) if rows else []
    cells = [names, *[[f"{r[n]:.4f}" if isinstance(r[n], float) else str(r[n]) for n in names] for r in rows]]
    width = [max(len(row[i]) for row in cells) for i in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, width, strict=True)).rstrip() for row in cells)


def save_legacy(path: str, rows: DataFrame) -> None:
    """``rows(page_content, source, page, embedding)`` as the one JSON object that read_legacy_index() takes.

    The format is one file with everything in it, so it is for small stores only; the rows pass through the driver one by one.
    """
    vectors, documents = [], []
    for r in rows.select("page_content", "source", "page", "embedding").toLocalIterator():
        vectors.append([float(x) for x in r.embedding])
        documents.append({"page_content": r.page_content, "metadata": {"source": r.source, "page": r.page}})
    Path(path).write_text(json.dumps({"embeddings": vectors, "documents": documents}, ensure_ascii=False), "utf-8")
