"""BM25 over postings tables; questions are scored together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens

K1, B = 1.5, 0.75
Tokenizer = Callable[[str], Column]
#: Questions that are sent to the executors at once; questions, terms and documents of one product.
QUERY_BLOCK, QUESTIONS, TERMS, SHARD_DOCS = 4096, 256, 512, 4096


def postings(docs: DataFrame, text: str = "page_content", tokenizer: Tokenizer = tokens) -> DataFrame:
    """(doc_idx, term, tf)."""
    return docs.select("doc_idx", F.explode(tokenizer(text)).alias("term")).groupBy("doc_idx", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, text: str = "page_content", tokenizer: Tokenizer = tokens) -> DataFrame:
    return docs.select("doc_idx", F.size(tokenizer(text)).cast("long").alias("dl"))


def statistics(docs: DataFrame, text: str = "page_content", tokenizer: Tokenizer = tokens) -> DataFrame:
    """One row (n_docs, avgdl); documents without tokens count."""
    return lengths(docs, text, tokenizer).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def explain(questions: DataFrame, docs: DataFrame, k1: float = K1, b: float = B, question: str = "question", tokenizer: Tokenizer = tokens) -> DataFrame:
    """(question_id, term, doc_idx, contribution) of every matching term; repeated query terms count once.

    Straight from texts, in DataFrame functions only: documents are tokenised once for postings and
    lengths, and once for the statistics, which are one broadcast row.
    """
    asked = questions.select("question_id", F.explode(F.array_distinct(tokenizer(question))).alias("term"))
    read = docs.select("doc_idx", tokenizer("page_content").alias("t")).select("doc_idx", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    post = read.join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc_idx", "dl", "term").agg(F.count("*").alias("tf"))
    n, avg = F.col("n_docs").cast("double"), F.greatest(F.col("avgdl"), F.lit(1e-12))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    weighed = post.join(frequencies(post), "term").crossJoin(F.broadcast(statistics(docs, tokenizer=tokenizer))).select("term", "doc_idx", (idf * gain).alias("contribution"))
    return asked.join(weighed, "term").select("question_id", "term", "doc_idx", "contribution")


def packed(docs: DataFrame, tokenizer: Tokenizer = tokens, n_docs: int | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(shard, term, df, docs): postings of one term and shard of documents in one row, ``docs`` an array of (doc_idx, tf, dl).

    A shard has about ``shard_docs`` documents, so no row is long however frequent its term is; texts are tokenised once.
    """
    shards = max(1, -(-(docs.count() if n_docs is None else n_docs) // shard_docs))
    read = docs.select(F.col("doc_idx").cast("long"), tokenizer("page_content").alias("t")).select("doc_idx", F.size("t").alias("dl"), F.explode("t").alias("term"))
    post = read.groupBy("doc_idx", "dl", "term").agg(F.count("*").cast("int").alias("tf")).withColumn("shard", F.pmod(F.xxhash64("doc_idx"), F.lit(shards)))
    rows = post.groupBy("shard", "term").agg(F.array_sort(F.collect_list(F.struct("doc_idx", "tf", "dl"))).alias("docs"))
    over = rows.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    return rows.join(over, "term").select("shard", "term", "df", "docs")


def search_packed(questions: DataFrame, rows: DataFrame, n_docs: int, avgdl: float, k: int, k1: float = K1, b: float = B, tokenizer: Tokenizer = tokens) -> DataFrame:
    """search() over the rows of packed(): only those of the questions' terms are read, and each shard's documents are scored in matrix products."""
    spark, found = rows.sparkSession, None
    listed = iter(questions.select("question_id", F.array_distinct(tokenizer("question")).alias("terms")).toLocalIterator())
    while block := [r for _, r in zip(range(QUERY_BLOCK), listed, strict=False)]:
        asked: dict[str, list[int]] = {}
        for i, r in enumerate(block):
            for t in r.terms:
                asked.setdefault(t, []).append(i)
        if not asked:
            continue
        shipped = spark.sparkContext.broadcast((np.array([r.question_id for r in block]), asked))
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in asked], "term string"))  # the terms of one block of questions
        some = rows.join(wanted, "term", "left_semi").repartition("shard").sortWithinPartitions("shard", "term")
        part = some.select("shard", "term", "df", "docs").mapInArrow(_scores(shipped, float(n_docs), max(avgdl, 1e-12), k, k1, b), "question_id long, doc_idx long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "question_id long, doc_idx long, score double")
    return top(found, k)


def _scores(shipped, n: float, avgdl: float, k: int, k1: float, b: float):
    def score(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, asked = shipped.value
        doc = np.unique(np.concatenate([x[2] for x in held]))
        for q0 in range(0, len(ids), QUESTIONS):
            total = np.zeros((min(QUESTIONS, len(ids) - q0), len(doc)))
            for t0 in range(0, len(held), TERMS):
                part = held[t0 : t0 + TERMS]
                weight, gain = np.zeros((len(total), len(part))), np.zeros((len(part), len(doc)))
                for j, (term, df, docs, tf, dl) in enumerate(part):
                    who = np.array(asked[term]) - q0
                    weight[who[(who >= 0) & (who < len(total))], j] = np.log((n - df + 0.5) / (df + 0.5) + 1)
                    gain[j, np.searchsorted(doc, docs)] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                total += weight @ gain
            total = np.round(total, 6)
            row, col = best(total, doc, k)
            some = total[row, col] > 0
            row, col = row[some], col[some]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q0 + row]), pa.array(doc[col]), pa.array(total[row, col])], ["question_id", "doc_idx", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            lists = batch["docs"]
            edge, flat = lists.offsets.to_numpy(), lists.flatten()
            first = edge[0] if len(edge) else 0
            columns = [flat.field(c).to_numpy() for c in ("doc_idx", "tf", "dl")]
            for i, (s, term, df) in enumerate(zip(*(batch[c].to_pylist() for c in ("shard", "term", "df")), strict=True)):
                if s != shard:
                    if held:
                        yield from score(held)
                    shard, held = s, []
                held.append((term, df, *[c[edge[i] - first : edge[i + 1] - first] for c in columns]))
        if held:
            yield from score(held)

    return run


def best(score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the best k of each row, by score and then the smaller ``doc``."""
    rows, cols = [], []
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k] if k < n else np.full(len(score), -np.inf)
    for i, low in enumerate(least):
        some = np.flatnonzero(score[i] >= low)
        some = some[np.lexsort((doc[some], -score[i, some]))[:k]]
        rows.append(np.full(len(some), i))
        cols.append(some)
    none = np.empty(0, np.int64)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (none, none)


def search(questions: DataFrame, docs: DataFrame, k: int, k1: float = K1, b: float = B, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(question_id, doc_idx, score, rank) of the best k; a document without a matching term has no row."""
    scored = explain(questions, docs, k1, b, tokenizer=tokenizer).groupBy("question_id", "doc_idx").agg(F.round(F.sum("contribution"), 6).alias("score"))
    return top(scored, k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """Best k a question by score, then doc_idx; ranks from 1.

    Scores are rounded before they are ranked (here and in the SQL that must agree), since sums of
    floating point numbers depend on how rows are dealt.
    """
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_idx")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
