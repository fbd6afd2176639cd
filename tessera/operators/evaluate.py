"""Evaluation: keyword coverage, per-question status, retrieval and generation summaries, question checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import has_any, is_body, ratio

#: Characters of keywords that go to the executors at once, as one automaton of some 60 bytes a character.
KEYWORD_CHARS = 1 << 20


def _keyword_blocks(questions: DataFrame, fold: Callable[[str], str]) -> Iterator[dict[str, set[int]]]:
    """Keywords and the questions that have them, KEYWORD_CHARS at a time."""
    by: dict[str, set[int]] = {}
    size = 0
    for r in questions.select("question_id", "expected_keywords").where("size(expected_keywords) > 0").toLocalIterator():
        for w in r.expected_keywords:
            if w is not None:
                size += 0 if fold(w) in by else len(w)
                by.setdefault(fold(w), set()).add(r.question_id)
        if size > KEYWORD_CHARS:
            yield by
            by, size = {}, 0
    if by:
        yield by


def keyword_hits(questions: DataFrame, docs: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(question_id, doc_idx, source, body): documents with any of a question's keywords.

    One automaton finds all keywords of a question set in one pass over each text; only a set with
    more than KEYWORD_CHARS of keywords takes further scans.  An empty keyword is in every text.
    """
    found, spark, fold = None, docs.sparkSession, str.lower if ignore_case else str
    frame = docs.select(F.col("page_content"), F.col("doc_idx").cast("long"), F.col("source"), F.coalesce(is_body("page_content"), F.lit(False)).alias("body"))
    for by in _keyword_blocks(questions, fold):
        shipped = spark.sparkContext.broadcast({w: tuple(ids) for w, ids in by.items()})

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, fold=fold) -> Iterator[pa.RecordBatch]:
            words = ahocorasick.Automaton()
            for w, ids in shipped.value.items():
                if w:
                    words.add_word(w, ids)
            always = set(shipped.value.get("", ()))
            if len(words):
                words.make_automaton()
            for batch in batches:
                who, at = [], []
                for i, cell in enumerate(batch.column(0)):
                    t = fold(cell.as_py() or "")
                    hit = set(always)
                    for _, ids in words.iter(t) if len(words) else ():
                        hit.update(ids)
                    who += sorted(hit)
                    at += [i] * len(hit)
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), *[c.take(pa.array(at, pa.int64())) for c in batch.columns[1:]]], ["question_id", "doc_idx", "source", "body"])

        part = frame.mapInArrow(run, "question_id long, doc_idx long, source string, body boolean")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "question_id long, doc_idx long, source string, body boolean")
    return found.dropDuplicates(["question_id", "doc_idx"]) if found is not part else found  # a question's keywords may lie in two blocks


def coverage(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, coverage): how many documents hold a keyword, zero too."""
    hits = keyword_hits(questions, docs).groupBy("question_id").agg(F.count("*").alias("coverage"))
    return questions.select("question_id").join(hits, "question_id", "left").select("question_id", F.coalesce("coverage", F.lit(0)).cast("long").alias("coverage"))


def typed(questions: DataFrame, docs: DataFrame, distractor: Column | None = None) -> DataFrame:
    """Questions with a type by where their keywords occur: no_answer, multi_hop (several sources) or single_fact; of the last, ``distractor`` picks those."""
    at = keyword_hits(questions, docs).groupBy("question_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("coverage"))
    n = F.coalesce(F.size("sources"), F.lit(0))
    kind = F.when(F.col("sources").isNull(), "no_answer").when(n > 1, "multi_hop").when(F.lit(False) if distractor is None else distractor, "distractor").otherwise("single_fact")
    return questions.join(at, "question_id", "left").select(*questions.columns, kind.alias("type"), F.when(n == 1, F.col("sources")[0]).alias("expected_source"), F.when(n > 1, F.col("sources")).alias("required_sources"), F.coalesce("coverage", F.lit(0)).cast("long").alias("coverage"))


def per_question(asked: DataFrame, ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Status of each question of typed(): NO_ANSWER, HOP_ALL, HOP_x.xx, INVALID, HIT@r or MISS, in this precedence."""
    rows = ranked.join(docs.select("doc_idx", "source", "page_content"), "doc_idx").join(asked.select("question_id", "expected_keywords"), "question_id")
    per = rows.groupBy("question_id").agg(
        F.min(F.when(has_any("page_content", "expected_keywords"), F.col("rank"))).alias("first_hit"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.min_by("source", "rank").alias("top1_source"), F.max("score").alias("top1_score"),
    )
    j = asked.join(per, "question_id", "left")
    hop = F.size(F.array_intersect("required_sources", F.coalesce("sources", F.array().cast("array<string>")))) / F.size("required_sources")
    status = (
        F.when(F.col("type") == "no_answer", "NO_ANSWER")
        .when(F.col("type") == "multi_hop", F.when(F.col("hop") == 1, "HOP_ALL").otherwise(F.concat(F.lit("HOP_"), F.format_string("%.2f", F.coalesce("hop", F.lit(0.0))))))
        .when(F.col("coverage") == 0, "INVALID").when(F.col("first_hit").isNotNull(), F.concat(F.lit("HIT@"), F.col("first_hit").cast("string"))).otherwise("MISS")
    )
    j = j.withColumn("hop", F.when(F.col("type") == "multi_hop", hop))
    return j.select("question_id", "type", status.alias("status"), "first_hit", "coverage", F.col("hop").alias("hop_coverage"), F.array_contains("sources", F.col("expected_source")).alias("source_hit"), (F.col("top1_source") == F.col("expected_source")).alias("source_at1"), "top1_source", F.when(F.col("required_sources").isNotNull(), F.array_sort(F.array_except("required_sources", F.coalesce("sources", F.array().cast("array<string>"))))).alias("missing"))


def summary(rows: DataFrame) -> DataFrame:
    """One row of hit rates, reciprocal rank, source accuracy and hop coverage over per_question()."""
    fact = F.col("type").isin("single_fact", "distractor")
    valid = fact & (F.col("status") != "INVALID")
    distractor, hop = valid & (F.col("type") == "distractor"), F.col("type") == "multi_hop"
    mean = lambda cond, x: F.avg(F.when(cond, x.cast("double")))
    return rows.agg(
        F.count("*").alias("total"), F.count(F.when(valid, 1)).alias("valid"),
        F.coalesce(mean(valid, F.coalesce(F.col("first_hit") == 1, F.lit(False)).cast("int")), F.lit(0.0)).alias("hit_at_1"),
        F.coalesce(mean(valid, F.col("first_hit").isNotNull().cast("int")), F.lit(0.0)).alias("hit_at_k"),
        F.coalesce(mean(valid, F.coalesce(1 / F.col("first_hit"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        mean(distractor, F.coalesce("source_hit", F.lit(False)).cast("int")).alias("source_hit_rate"), mean(distractor, F.coalesce("source_at1", F.lit(False)).cast("int")).alias("source_at1_rate"),
        mean(hop, F.col("hop_coverage")).alias("hop_coverage"), mean(hop, (F.col("hop_coverage") == 1).cast("int")).alias("hop_full_rate"),
    )


def generation(rows: DataFrame, by_type: bool = False) -> DataFrame:
    """Summary of answers (type, refused, expect_refusal, citation_count, citation_valid, n_sources, faithfulness), over all or by type."""
    answered = ~F.col("refused")
    n = lambda cond: F.count(F.when(cond, 1))
    should, shouldnt = F.col("expect_refusal"), ~F.col("expect_refusal")
    total = F.sum(F.when(answered, F.col("citation_count")))
    return (rows.groupBy("type") if by_type else rows.groupBy()).agg(
        F.count("*").alias("total"), n(answered).alias("answered"), ratio(n(answered & (F.col("citation_count") > 0)), n(answered)).alias("citation_coverage"),
        ratio(F.sum(F.when(answered, F.col("citation_valid"))), total).alias("citation_validity"), n(answered & (F.col("citation_valid") < F.col("citation_count"))).alias("fabricated"),
        F.avg(F.when(answered, F.col("faithfulness"))).alias("faithfulness"), ratio(n(should & ~answered), n(should)).alias("refusal_rate"), ratio(n(shouldnt & ~answered), n(shouldnt)).alias("over_refusal_rate"),
        ratio(n(answered & (F.col("n_sources") > 1)), n(answered)).alias("multi_source_rate"),
    )


def self_check(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, body_hits, own_hits, best_other, verdict) of keywords in running text, against the labelled source.

    A no_answer question is inverted: its ``absent_terms`` (its keywords if it has no such column)
    must occur nowhere.  A multi_hop question without keywords is skipped.
    """
    absent = F.col("type") == "no_answer"
    words = F.when(absent, F.col("absent_terms")).otherwise(F.col("expected_keywords")) if "absent_terms" in asked.columns else F.col("expected_keywords")
    looked = asked.withColumn("expected_keywords", words)
    hits = keyword_hits(looked, docs, ignore_case=True)
    hits = hits.groupBy("question_id", "source").agg(F.count(F.when(F.col("body"), 1)).alias("n"), F.count("*").alias("all"))
    j = looked.select("question_id", "type", "expected_source", (F.coalesce(F.size("expected_keywords"), F.lit(0)) > 0).alias("keyed")).join(hits, "question_id", "left")
    own = F.col("source").eqNullSafe(F.col("expected_source"))
    per = j.groupBy("question_id", "type", "expected_source", "keyed").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("body_hits"), F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("own_hits"), F.coalesce(F.max(F.when(~own, F.col("n"))), F.lit(0)).alias("best_other"), F.coalesce(F.sum("all"), F.lit(0)).alias("all"))
    verdict = (
        F.when(absent, F.when(F.col("all") > 0, "NOT_ABSENT").otherwise("OK")).when((F.col("type") == "multi_hop") & ~F.col("keyed"), "SKIPPED")
        .when(F.col("body_hits") == 0, "NO_BODY_HIT").when(F.col("expected_source").isNull(), "OK").when(F.col("own_hits") == 0, "SOURCE_ZERO").when(F.col("own_hits") < F.col("best_other"), "SOURCE_LESS").otherwise("OK")
    )
    return per.select("question_id", "body_hits", "own_hits", "best_other", verdict.alias("verdict"))


def top_sources(asked: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """(question_id, source, n, rank): the k sources with most keyword hits in running text."""
    hits = keyword_hits(asked, docs, ignore_case=True).where("body").groupBy("question_id", "source").agg(F.count("*").alias("n"))
    order = Window.partitionBy("question_id").orderBy(F.desc("n"), "source")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def memoised(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests(key, ...)`` with the cached ``value`` and whether it must still be judged."""
    return requests.join(cache.select("key", "value"), "key", "left").withColumn("miss", F.col("value").isNull())


def type_counts(asked: DataFrame) -> DataFrame:
    return asked.groupBy("type").agg(F.count("*").alias("n"))


def chosen(asked: DataFrame, only_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Questions of one type, then the first ``limit`` by id."""
    some = asked if only_type is None else asked.where(F.col("type") == only_type)
    return some if limit is None else some.orderBy("question_id").limit(limit)


def reports(rows: DataFrame) -> DataFrame:
    """(report, question_id, detail): misses, invalid questions, and hops that aren't whole with the sources they lack."""
    kind = F.when(F.col("status") == "MISS", "miss").when(F.col("status") == "INVALID", "invalid").when((F.col("type") == "multi_hop") & (F.col("status") != "HOP_ALL"), "partial_hop")
    detail = F.when(kind == "partial_hop", F.array_join(F.coalesce("missing", F.array().cast("array<string>")), ",")).otherwise(F.coalesce("top1_source", F.lit("")))
    return rows.select(kind.alias("report"), "question_id", detail.alias("detail")).where("report is not null")
