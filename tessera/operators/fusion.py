"""Reciprocal rank fusion of ranked channels, and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def fuse(channels: dict[str, DataFrame], k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """(question_id, doc_idx, <channel>_rank..., score, rank); a channel that missed has a null rank.

    The channels meet in full outer joins.  (A union of ranked channels, summed by document, gave wrong
    rows in self joins: in Spark 4.1 the union passes on its children's partitioning, which adaptive
    execution then coalesces apart.)
    """
    sides = [c.select("question_id", "doc_idx", F.col("rank").alias(f"{name}_rank")) for name, c in channels.items()]
    rows = reduce(lambda a, b: a.join(b, ["question_id", "doc_idx"], "full"), sides)
    parts = [F.coalesce(F.lit(float((weights or {}).get(name, 1.0))) / (k + F.col(f"{name}_rank")), F.lit(0.0)) for name in channels]
    fused = rows.withColumn("score", F.round(reduce(lambda a, b: a + b, parts), 9))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_idx")
    return fused.withColumn("rank", F.row_number().over(order).cast("long"))


def model_scorer(make: Callable, batch: int = 32) -> Callable:
    """A scorer of (question, text) by a model: ``make()`` is called once a Python worker's task and gives a function of two lists to scores.

    Scores are used as they are returned.
    """

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = make()
        for asked, texts in parts:
            out: list[float] = []
            for at in range(0, len(asked), batch):
                out += score(asked[at : at + batch].tolist(), texts[at : at + batch].tolist())
            yield pd.Series(out, dtype="float64")

    return scored


def lexical_score(question, text):
    """Share of the question's distinct tokens that the text holds: the built-in scorer."""
    q = F.array_distinct(tokens(question))
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)), 4)


def rerank(fused: DataFrame, questions: DataFrame, docs: DataFrame, candidate_k: int, scorer: Callable = lexical_score) -> DataFrame:
    """The first ``candidate_k`` fused rows ordered by ``scorer(question, text)``; the rest are dropped."""
    pool = fused.where(F.col("rank") <= candidate_k).withColumnRenamed("rank", "fused_rank")
    pool = pool.join(questions.select("question_id", "question"), "question_id").join(docs.select("doc_idx", "page_content"), "doc_idx")
    scored = pool.withColumn("rerank", scorer(F.col("question"), F.col("page_content")).cast("double")).drop("question", "page_content")
    order = Window.partitionBy("question_id").orderBy(F.desc("rerank"), "fused_rank", "doc_idx")
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))
