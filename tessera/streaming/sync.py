"""Incremental ingestion of files, masking of the refusal sentinel in token streams, answer events and their transport."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import SENTINEL, basename
from tessera.operators import store
from tessera.sources import shared
from tessera.sources.tables import read_pages, text_pages


def sync(spark: SparkSession, source: str, path: str, extractor: Callable[[bytes], list[str]] = text_pages, glob: str = "*", recreate: bool = False, prune: bool = False, make: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Take up new and changed files of a folder; returns how many were new, changed, same and removed, and how many rows came.

    Files are told by name and SHA-1 against the ledger in the store, so a rewritten file is read
    again and a repeated call does nothing.  ``make`` turns pages into rows (splits or embeds them).
    Equal contents are taken once, the first by file name and page.  The store only grows, as a
    changed or removed file's old rows may be another's too, unless ``prune`` drops the rows of
    contents that no file holds any more.  The ledger is written last: a call that dies is repeated.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(source).select(basename("path").alias("name"), F.sha1("content").alias("sha1"))
    ledger = f"{path}/ledger"
    before = spark.read.parquet(ledger) if shared.exists(spark, ledger) and not recreate else spark.createDataFrame([], "name string, sha1 string")
    states = store.ledger_diff(files, before)
    counts = {"new": 0, "changed": 0, "same": 0, "removed": 0} | {r.state: r["count"] for r in states.groupBy("state").count().collect()}
    pages = read_pages(spark, source, extractor, glob)
    fresh = pages.withColumn("name", basename("source")).join(states.where("state in ('new', 'changed')").select("name"), "name", "left_semi")
    number = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    rows = fresh.withColumn("arrival", F.concat_ws("/", "name", number("page")))
    if make:
        rows = make(rows)
        rows = rows.withColumn("arrival", F.concat_ws("/", "arrival", number("chunk_no"))) if "chunk_no" in rows.columns else rows
    rows = rows.withColumn("doc_idx", F.xxhash64("arrival", "file_sha1"))
    added = 0
    if counts["new"] + counts["changed"] or not store.exists(spark, path) or recreate:
        added = store.add(spark, rows, path, recreate=recreate, order="arrival")
    if prune and counts["changed"] + counts["removed"]:
        store.keep_only(spark, path, store.content_ids(make(pages) if make else pages))
    now = [(r.name, r.sha1) for r in files.collect()]  # names and digests only: one short row a file
    spark.createDataFrame(now, "name string, sha1 string").coalesce(1).write.mode("overwrite").parquet(ledger)
    return counts | {"added": added}


def watch(spark: SparkSession, source: str, path: str, checkpoint: str, extractor: Callable[[bytes], list[str]] = text_pages, glob: str = "*") -> None:
    """sync() as a stream: whenever files appear (availableNow), the folder is compared with the ledger once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(source)

    def take(batch: DataFrame, _: int) -> None:
        sync(spark, source, path, extractor, glob)

    files.select("path").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def masked_tokens(tokens: Column, sentinel: str = SENTINEL) -> Column:
    """masked() as a column: the array of shown tokens of an array of tokens, by one fold."""
    state = lambda held, shown, kind: F.struct(held.alias("held"), shown.alias("shown"), kind.alias("kind"))
    none = F.array().cast("array<string>")

    def step(s: Column, t: Column) -> Column:
        held = F.concat(s["held"], t)
        start = F.regexp_replace(held, r"(?U)^\s+", "")
        refused, still = start.startswith(F.lit(sentinel)), F.lit(sentinel).startswith(start)
        opened = state(F.lit(""), F.array(held), F.lit("open"))
        return (
            F.when(s["kind"] == "open", state(F.lit(""), F.concat(s["shown"], F.array(t)), F.lit("open"))).when(s["kind"] == "shut", state(F.lit(""), none, F.lit("shut")))
            .when(refused, state(F.lit(""), none, F.lit("shut"))).when(~still, opened).otherwise(state(held, none, F.lit("held")))
        )

    finish = lambda s: F.when((s["kind"] == "held") & (s["held"] != ""), F.array(s["held"])).otherwise(s["shown"])
    return F.aggregate(F.coalesce(tokens, none), state(F.lit(""), none, F.lit("held")), step, finish)


def masked(tokens: Iterable[str], sentinel: str = SENTINEL) -> Iterator[str]:
    """Tokens to show: none while the answer may still begin with the sentinel, and none at all if it does."""
    held, open_ = "", True
    for t in tokens:
        if not open_:
            yield t
            continue
        held += t
        start = held.lstrip()
        if start.startswith(sentinel):
            return
        if not sentinel.startswith(start):
            open_ = False
            yield held
    if open_ and held and not held.lstrip().startswith(sentinel):
        yield held


def answer_events(sources: list[dict], tokens: Iterable[str], started: float | None = None, retrieve_ms: float = 0.0) -> Iterator[dict]:
    """sources, tokens as they come, done; a refused answer has no token events.  Without sources the tokens aren't asked for."""
    started = time.monotonic() if started is None else started
    yield {"type": "sources", "sources": sources, "retrieve_ms": retrieve_ms}
    raw: list[str] = []

    def heard() -> Iterator[str]:
        for t in tokens:
            raw.append(t)
            yield t

    shown = ""
    for t in masked(heard()) if sources else ():
        shown += t
        yield {"type": "token", "text": t}
    refused = not sources or SENTINEL in "".join(raw)[:40].upper()
    yield {"type": "done", "answer": "" if refused else shown, "raw_answer": "".join(raw) if sources else SENTINEL, "refused": refused, "gen_ms": round(1000 * (time.monotonic() - started), 1)}


def sse(events: Iterable[dict]) -> Iterator[str]:
    """Events as a server sends them: ``data: {json}`` and a blank line; ``done`` gets total_ms, and a failure is an ``error`` event."""
    before = 0.0
    try:
        for e in events:
            before = e.get("retrieve_ms", before)
            out = e | {"total_ms": round(before + e.get("gen_ms", 0.0), 1)} if e["type"] == "done" else e
            yield f"data: {json.dumps(out, ensure_ascii=False)}\n\n"
    except Exception as failure:  # what was sent can't be taken back, so the client is told
        yield f"data: {json.dumps({'type': 'error', 'message': str(failure)}, ensure_ascii=False)}\n\n"
