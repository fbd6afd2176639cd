"""From ranked rows to contexts, prompts and checked answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SENTINEL, basename, cache_key, citation_report, claims, is_refusal, normal_page, page_of, strip, verdict
from tessera.operators.evaluate import memoised

#: Own wording; the citation form and the sentinel are what the checks read.
_HEAD = "Answer only from the material below; use no other knowledge.\n\nMaterial:\n{context}\n\nQuestion:\n{question}\n\nRules:\n1. Do not guess what the material does not say.\n"
_CITE = "2. After each statement of fact give its source as [来源: file 第N页], with Source and Page as the material states them.\n"
_PLAIN = "2. Do not name sources.\n"
_REFUSE = f"3. If the material is not enough, reply only {SENTINEL}\n"
_ALWAYS = "3. If the material is not enough, give the closest answer it supports.\n"
PROMPTS = {"full": (_HEAD + _CITE + _REFUSE, "v1-cite"), "no_refusal": (_HEAD + _CITE + _ALWAYS, "v1-norefuse"), "no_cite": (_HEAD + _PLAIN + _REFUSE, "v1-nocite")}


def contexts(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, context): numbered material in rank order; at most top_k rows a question."""
    page = page_of("page_label", "page")
    piece = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit("]\nSource: "), basename("source"), F.lit("\nPage: "), page, F.lit("\nContent:\n"), F.col("page_content"), F.lit("\n"))
    rows = ranked.join(docs, "doc_idx").select("question_id", F.struct("rank", piece.alias("piece")).alias("x"))
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("question_id", F.array_join(F.transform("x", lambda x: x["piece"]), "\n").alias("context"))


def legacy_contexts(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, context) with ``Chunk:`` (the chunk's number) where contexts() has the page."""
    piece = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit("]\nSource: "), basename("source"), F.lit("\nChunk: "), F.coalesce(F.col("chunk").cast("string"), F.lit("unknown")), F.lit("\nContent:\n"), F.col("page_content"), F.lit("\n"))
    rows = ranked.join(docs, "doc_idx").select("question_id", F.struct("rank", piece.alias("piece")).alias("x"))
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("question_id", F.array_join(F.transform("x", lambda x: x["piece"]), "\n").alias("context"))


def prompt(question: Column, context: Column, variant: str = "full") -> tuple[Column, str]:
    """The prompt column and its version; an unknown variant raises."""
    if variant not in PROMPTS:
        raise ValueError(f"unknown prompt variant {variant!r}; one of {sorted(PROMPTS)}")
    template, version = PROMPTS[variant]
    before, rest = template.split("{context}")
    middle, after = rest.split("{question}")
    return F.concat(F.lit(before), context, F.lit(middle), question, F.lit(after)), version


def citation_keys(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, keys): the (file, page) pairs that a question's answer may cite."""
    key = F.struct(basename("source", "").alias("file"), normal_page(page_of("page_label", "page")).alias("page"))
    return ranked.join(docs, "doc_idx").groupBy("question_id").agg(F.array_sort(F.collect_set(key)).alias("keys"))


#: A language model: a column function of (question, context, prompt) to the raw answer.  Anything that isn't a column function comes by model().
LanguageModel = Callable[[Column, Column, Column], Column]
#: Own wording of what is shown where there is no answer.
NO_QUESTION, REFUSED, NO_MODEL = "Please ask a question.", "The material does not answer this question.", "No language model is set. These passages may help:\n\n"


def model(make: Callable[[], Callable[[str], str]], failed: str = "") -> LanguageModel:
    """A model by client: ``make()`` is called once a task and gives a function of a prompt to an answer; a call that fails says ``failed``."""

    @F.pandas_udf("string")
    def ask(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()

        def one(p: str | None) -> str | None:
            try:
                return client(p) if p is not None else None
            except Exception:  # one failed call doesn't stop the table
                return failed

        for part in prompts:
            yield part.map(one)

    return lambda question, context, prompt: ask(prompt)


def extractive(question: Column, context: Column, prompt: Column) -> Column:
    """The built-in model: the first 80 characters of the first material, with its source; the sentinel where it has none."""
    part = lambda name: F.regexp_extract(context, rf"(?s)^\[Document 1\]\nSource: ([^\n]*)\nPage: ([^\n]*)\nContent:\n(.*)", name)
    said = F.substring(F.regexp_replace(part(3), r"\s+", " "), 1, 80)
    return F.when(said == "", SENTINEL).otherwise(F.concat(said, F.lit(" [来源: "), part(1), F.lit(" 第"), part(2), F.lit("页]")))


def invoke(questions: DataFrame, ranked: DataFrame, docs: DataFrame, llm: LanguageModel | None = extractive, variant: str = "full") -> DataFrame:
    """Answers of all questions: question_id, branch, answer, raw_answer, refused, context, citations, prompt_version.

    Branches: ``no_question`` (empty: refused, nothing is retrieved), ``no_documents`` (refused, the
    model isn't asked), ``no_model`` (the passages are shown), ``refused`` (the model's answer holds the
    sentinel at its beginning; citations are those of an empty answer) and ``answered``.  A model is
    never asked without material.
    """
    keys = citation_keys(ranked, docs)
    j = questions.select("question_id", "question").join(contexts(ranked, docs), "question_id", "left").join(keys, "question_id", "left")
    question, context = F.coalesce("question", F.lit("")), F.coalesce("context", F.lit(""))
    ask, version = prompt(question, context, variant)
    asked = (question != "") & F.col("context").isNotNull()
    raw = F.lit("") if llm is None else F.coalesce(strip(llm(question, context, F.when(asked, ask))), F.lit(""))
    j = j.withColumn("raw", F.when(question == "", "").when(~asked, SENTINEL).otherwise(raw))
    refused = is_refusal("raw")
    branch = F.when(question == "", "no_question").when(F.col("context").isNull(), "no_documents").when(F.lit(llm is None), "no_model").when(refused, "refused").otherwise("answered")
    j = j.withColumn("branch", branch)
    none = F.col("branch") != "answered"
    answer = F.when(F.col("branch") == "no_question", NO_QUESTION).when(F.col("branch") == "no_model", F.concat(F.lit(NO_MODEL), context)).when(none, REFUSED).otherwise(F.col("raw"))
    known = F.coalesce("keys", F.array().cast("array<struct<file:string,page:string>>"))
    return j.select(
        "question_id", "branch", answer.alias("answer"), F.col("raw").alias("raw_answer"), F.col("branch").isin("no_question", "no_documents", "refused").alias("refused"),
        F.when(F.col("branch") == "no_question", "").otherwise(context).alias("context"), citation_report(F.when(none, "").otherwise(F.col("raw")), known).alias("citations"), F.lit(version).alias("prompt_version"),
    )


#: Most characters of a text that a judge of relevance is shown, of a context and of an answer that one of faithfulness is.
JUDGE_TEXT, JUDGE_CONTEXT, JUDGE_ANSWER = 1200, 6000, 2000
Judge = Callable[[Column, Column], Column]


def lexical_judge(question: Column, text: Column) -> Column:
    """The built-in judge's reply: yes if a fifth of the question's tokens are in the text."""
    from tessera.operators.fusion import lexical_score

    share = lexical_score(question, text)
    return F.concat(F.when(share >= 0.2, "yes").otherwise("no"), F.lit(" | share "), share.cast("string"))


def relevance(pairs: DataFrame, cache: DataFrame, judge: Judge = lexical_judge, version: str = "r1") -> tuple[DataFrame, DataFrame]:
    """Judge ``pairs(question, text, ...)`` by the cache and, on misses, ``judge(question, first JUDGE_TEXT characters)``.

    Returns the pairs with ``key, verdict, reason, miss``, and the new replies (``key, value``) for
    merge_cache().  A null reply counts as not relevant.
    """
    key = cache_key(F.lit(version), "question", "text")
    probed = memoised(pairs.withColumn("key", key), cache)
    said = F.when(F.col("miss"), F.coalesce(judge(F.col("question"), F.substring("text", 1, JUDGE_TEXT)), F.lit("no | (call failed)"))).otherwise(F.col("value"))
    judged = probed.withColumn("value", said)
    fresh = judged.where("miss").groupBy("key").agg(F.min("value").alias("value"))
    v = verdict("value")
    return judged.withColumns({"verdict": v["verdict"], "reason": v["reason"]}).drop("value"), fresh


def lexical_claims(answer: Column, context: Column) -> Column:
    """The built-in judge of faithfulness: each sentence of the answer is a claim, supported if the context holds it."""
    said = F.filter(F.transform(F.split(F.regexp_replace(answer, r"\[[^\]]*\]", ""), r"[.!?]\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.to_json(F.struct(F.transform(said, lambda x: F.struct(F.substring(x, 1, 60).alias("claim"), F.contains(context, x).alias("supported"), F.lit("").alias("reason"))).alias("claims")))


def faithfulness(answers: DataFrame, cache: DataFrame, judge: Judge = lexical_claims, version: str = "f1") -> tuple[DataFrame, DataFrame]:
    """Judge ``answers(answer, context, ...)``: adds ``claims`` (total, supported, score, parse_failed); and the new replies.

    The judge is shown JUDGE_CONTEXT and JUDGE_ANSWER characters; the key covers all.  A reply that can't be read has a null score.
    """
    probed = memoised(answers.withColumn("key", cache_key(F.lit(version), "answer", "context")), cache)
    said = F.when(F.col("miss"), F.coalesce(judge(F.substring("answer", 1, JUDGE_ANSWER), F.substring("context", 1, JUDGE_CONTEXT)), F.lit(""))).otherwise(F.col("value"))
    judged = probed.withColumn("value", said)
    fresh = judged.where("miss").groupBy("key").agg(F.min("value").alias("value"))
    return judged.withColumn("claims", claims("value")).drop("value", "miss", "key"), fresh


def generation_rows(answers: DataFrame, typed: DataFrame, judged: DataFrame) -> DataFrame:
    """What the summaries of answers count: invoke()'s rows with the questions' types and faithfulness()'s claims."""
    j = answers.join(typed.select("question_id", "type"), "question_id").join(judged.select("question_id", "claims"), "question_id", "left")
    c = F.col("citations")
    return j.select("question_id", "type", "refused", (F.col("type") == "no_answer").alias("expect_refusal"), c["count"].alias("citation_count"), c["valid"].alias("citation_valid"), F.size(c["cited_sources"]).alias("n_sources"), F.when(~F.col("refused"), F.col("claims")["score"]).alias("faithfulness"))
