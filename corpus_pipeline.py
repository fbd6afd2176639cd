"""A corpus pipeline of five operators: each stage's rows are written as Parquet and reread by the next.

Every stage but the last returns the columns of ``documents``; extra columns of the input go along,
whatever their names.  In every stage an empty table stays empty, texts count whole however long, and
repeated rows are separate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, simhash, suffix, toxicity
from tessera.llm.common import Scratch, finished


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with numbered columns, which clash with nothing that an operator makes, and their names."""
    named = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*named.values()), named


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below 0.5, by a model fitted on the labels of ``docs`` that aren't held out.

    Null and empty texts have no evidence against them, and stay unless no label is clean.  A score of
    exactly 0.5 (a table without usable labels gives it to all) goes.  Null ids are scored but not fitted.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, named = _plain(docs)
    found = toxicity.score(plain, model, text=named["text"], out="score")
    return found.where("score < 0.5").select(*named.values()).toDF(*named)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id's.

    Null, empty and blank texts have one fingerprint, so of all of these together one stays.  A null id
    is larger than all others; of rows with the same smallest id one stays.
    """
    plain, named = _plain(docs)
    found = simhash.near_duplicates(plain, named["doc_id"], named["text"], keep=list(named.values()))
    return found.where("kept").select(*named.values()).toDF(*named)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that strings of 50 bytes of earlier documents cover; n_chars follows.

    A document stays even if nothing of its text is left; a null text becomes an empty one.  A null id
    comes after all others; rows that share an id cut nothing from each other.
    """
    plain, named = _plain(docs)
    left = suffix.dedup_substrings(plain, named["doc_id"], named["text"], keep=[c for n, c in named.items() if n not in ("text", "n_chars")], as_text=True)
    own = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[own.get(n, F.col(c)).alias(c) for n, c in named.items()]).toDF(*named)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a window of the benchmark.

    Null and empty texts have no words, and stay; ids don't matter.
    """
    plain, named = _plain(docs)
    found = decontam.contamination(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=named["text"], keep=list(named.values()))
    return found.where(~decontam.contaminated()).select(*named.values()).toDF(*named)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mixture takes of it: doc_id, source, size, source_size, target, taken.

    Null and empty texts have size 0 and nothing is taken of them; a null source is the last one.
    """
    _, parts = mixing.mix(docs)
    return parts.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The stages fit models and sort suffixes, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote for itself goes when its rows are written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with finished():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
