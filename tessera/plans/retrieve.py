"""One plan for all questions: recall by channel, fusion, optional reranking, best top_k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions.text import basename, page_of, tokens
from tessera.functions.vectors import hash_embed
from tessera.operators import dense, fusion, sparse
from tessera.operators.index import Index

#: A retriever: questions(question_id, question) to ranked rows.
Retriever = Callable[[DataFrame], DataFrame]


def channels(questions: DataFrame, docs: DataFrame | Index, config: EngineConfig, embed=hash_embed, tokenizer=tokens) -> dict[str, DataFrame]:
    """The ranked rows of each channel of the mode, ``candidate_k`` a question, of a kept index or straight from ``docs``."""
    c, out = config, {}
    if c.mode in ("vector", "hybrid"):
        asked = embed(questions.select("question_id", "question"), "question")
        if isinstance(docs, Index):
            out["vector"] = docs.vectors(asked, c.candidate_k, c.nprobe if c.index == "ivf" else None)
        else:
            vectors = docs if "embedding" in docs.columns else embed(docs.select("doc_idx", "page_content"), "page_content")
            out["vector"] = dense.exact(asked, vectors.select("doc_idx", "embedding"), c.candidate_k)
    if c.mode in ("bm25", "hybrid"):
        out["bm25"] = docs.terms(questions, c.candidate_k, tokenizer) if isinstance(docs, Index) else sparse.search(questions, docs, c.candidate_k, tokenizer=tokenizer)
    return out


def retrieve(questions: DataFrame, docs: DataFrame | Index, config: EngineConfig | None = None, embed=hash_embed, scorer=fusion.lexical_score, tokenizer=tokens) -> DataFrame:
    """``questions(question_id, question)`` x ``docs(doc_idx, page_content)``, or an opened index, to ranked rows.

    Columns: question_id, doc_idx, rank, score, score_kind, vector_rank, bm25_rank.  A single channel
    keeps its own score (cosine or bm25) and isn't fused.  ``docs`` may bring an ``embedding``.  The
    score threshold of the settings doesn't apply here (see similar()).
    """
    c = config or EngineConfig()
    found = channels(questions, docs, c, embed, tokenizer)
    if len(found) == 2:
        ranked, kind = fusion.fuse(found, c.rrf_k, {"vector": c.vector_weight, "bm25": c.bm25_weight}), "rrf"
    else:
        (name, only), = found.items()
        kind = {"vector": "cosine", "bm25": "bm25"}[name]
        ranks = {n: F.col("rank") if n == name else F.lit(None).cast("long") for n in ("vector", "bm25")}
        ranked = only.select("*", *[r.alias(f"{n}_rank") for n, r in ranks.items()])
    if c.rerank:
        texts = docs.rows if isinstance(docs, Index) else docs
        ranked = fusion.rerank(ranked.drop("score").withColumn("score", F.col("rank").cast("double")), questions, texts, c.candidate_k, scorer).drop("score").withColumnRenamed("rerank", "score")
        kind = "rerank"
    return ranked.where(F.col("rank") <= c.top_k).select("question_id", "doc_idx", "rank", "score", F.lit(kind).alias("score_kind"), "vector_rank", "bm25_rank")


def similar(queries: DataFrame, index: Index, config: EngineConfig | None = None, k: int | None = None, threshold: float | None = None) -> DataFrame:
    """Vector search alone: ``queries(question_id, embedding)``; the threshold (the settings' if none is given) cuts after the best k."""
    c = config or EngineConfig()
    return index.vectors(queries, k or c.top_k, c.nprobe if c.index == "ivf" else None, c.score_threshold if threshold is None else threshold)


def retriever(docs: DataFrame | Index, mode: str = "hybrid", **settings) -> Retriever:
    """A function from questions to ranked rows; an unknown mode raises."""
    config = EngineConfig(mode=mode, **settings)
    return lambda questions: retrieve(questions, docs, config)


def api_rows(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """What a client is shown: rank, source (base name), page, text, score and the ranks in each channel."""
    rows = ranked.join(docs.select("doc_idx", "source", "page", "page_label", "page_content"), "doc_idx")
    return rows.select("question_id", "rank", basename("source").alias("source"), page_of("page_label", "page").alias("page"), F.col("page_content").alias("text"), "score", "score_kind", "vector_rank", "bm25_rank")


def search_json(questions: DataFrame, rows: DataFrame, mode: str) -> DataFrame:
    """(question_id, body): the reply to each question as JSON, results in rank order; at most top_k of them."""
    item = F.struct("rank", "source", "page", "text")
    listed = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("results"), F.first("score_kind").alias("score_kind"))
    full = questions.select("question_id", "question").join(listed, "question_id", "left")
    body = F.struct(F.col("question").alias("query"), F.lit(mode).alias("mode"), F.coalesce("score_kind", F.lit("none")).alias("score_kind"), F.coalesce("results", F.array().cast("array<struct<rank:bigint,source:string,page:string,text:string>>")).alias("results"))
    return full.select("question_id", F.to_json(body).alias("body"))
