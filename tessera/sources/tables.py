"""Sources: parquet tables as corpus and questions, JSON question sets, binary page files, legacy indexes, invented vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import newlines, strip

QUESTION = "id string, type string, question string, expected_keywords array<string>, expected_source string, required_sources array<string>, absent_terms array<string>, source_hint string, note string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Document ids that one window task numbers.
STRETCH = 4096


def corpus(documents: DataFrame, pages: bool = True) -> DataFrame:
    """documents as pages: doc_idx, source, page (from 0), page_label (text, from 1), total_pages, page_content.

    Without ``pages`` only doc_idx, source and page_content, which need no numbering.  Pages are
    numbered in stretches of ids and the stretches' sums are added, so a source with a third of all
    documents isn't one task's work.
    """
    rows = documents.select(F.col("doc_id").alias("doc_idx"), "source", F.col("text").alias("page_content"))
    if not pages:
        return rows
    rows = rows.withColumn("stretch", F.floor(F.col("doc_idx") / STRETCH))
    whole = Window.partitionBy("source")
    before = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    sums = sums.select(F.col("source").alias("s"), F.col("stretch").alias("x"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("total_pages"))
    page = (F.col("base") + F.row_number().over(Window.partitionBy("source", "stretch").orderBy("doc_idx")) - 1).cast("int")
    numbered = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("x"))).withColumn("page", page)
    return numbered.select("doc_idx", "source", "page", (F.col("page") + 1).cast("string").alias("page_label"), "total_pages", "page_content")


def questions(benchmark: DataFrame) -> DataFrame:
    """benchmark items as questions; the keyword is the item's beginning."""
    return benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.array(F.substring("text", 1, 60)).alias("expected_keywords"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions, or an object that holds it as ``questions``; the type defaults to single_fact."""
    raw = spark.read.text(path, wholetext=True)
    body = F.col("value")
    listed = F.when(F.trim(body).startswith("["), F.from_json(body, f"array<struct<{_struct(QUESTION)}>>")).otherwise(F.from_json(body, f"struct<questions:array<struct<{_struct(QUESTION)}>>>")["questions"])
    return raw.select(F.inline(listed)).withColumn("type", F.coalesce("type", F.lit("single_fact")))


def _struct(ddl: str) -> str:
    return ", ".join(":".join(p.strip().split(" ", 1)) for p in ddl.split(", "))


def text_pages(content: bytes) -> list[str]:
    """Built-in extractor: UTF-8 text, pages parted by form feeds.  PDF libraries plug in the same way."""
    return content.decode("utf-8").split("\f")


def read_pages(spark: SparkSession, path: str, extractor: Callable[[bytes], list[str]] = text_pages, glob: str = "*", on_error: str = "skip") -> DataFrame:
    """A row for each page of each file, blank ones kept, with the file's SHA-1; ``error`` rows are skipped unless asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, digest, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = extractor(content)
                    rows += [(source, digest, i, str(i + 1), len(found), t, None) for i, t in enumerate(found)]
                except Exception as e:  # one unreadable file doesn't stop the scan
                    if on_error == "raise":
                        raise
                    rows.append((source, digest, None, None, 0, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["source", "file_sha1", "page", "page_label", "total_pages", "page_content", "error"])

    made = files.select("path", F.sha1("content"), "content").mapInArrow(run, "source string, file_sha1 string, page int, page_label string, total_pages int, page_content string, error string")
    made = made.withColumn("page_content", newlines("page_content"))
    return made if on_error == "keep" else made.where("error is null").drop("error")


def read_legacy_index(spark: SparkSession, path: str) -> DataFrame:
    """``{"embeddings": [[..]], "documents": [{page_content, metadata}]}`` as (doc_idx, page_content, source, page, embedding)."""
    schema = "struct<embeddings:array<array<float>>,documents:array<struct<page_content:string,metadata:struct<source:string,page:int,page_label:string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    rows = raw.select(F.posexplode(F.arrays_zip("j.documents", "j.embeddings")).alias("doc_idx", "x"))
    return rows.select(F.col("doc_idx").cast("long"), "x.documents.page_content", "x.documents.metadata.*", F.col("x.embeddings").alias("embedding"))


def invented_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """(doc_idx, embedding): seeded normal unit vectors, alike however they are partitioned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = [np.random.default_rng([seed, int(i)]).normal(size=dim) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v / np.linalg.norm(v) for v in x], pa.list_(pa.float64()))], ["doc_idx", "embedding"])

    return spark.range(n).mapInArrow(run, "doc_idx long, embedding array<double>")


def noisy_copies(vectors: DataFrame, n: int, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """``n`` rows that repeat ``vectors`` with normal noise, normalised."""
    from tessera.functions.vectors import l2_normalise

    times = -(-n // max(1, vectors.count()))
    rows = vectors.select("embedding", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy"))
    rows = rows.select(F.transform("embedding", lambda x: x + noise * F.randn(seed)).alias("embedding"))
    return rows.limit(n).select(F.monotonically_increasing_id().alias("doc_idx"), l2_normalise(F.col("embedding")).alias("embedding"))


def sampled(rows: DataFrame, key: str, n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones however rows are dealt: the smallest digests of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def whole_documents(pages: DataFrame) -> DataFrame:
    """``pages(source, page, page_content)`` as one row a file: pages joined by a blank line and stripped; files without text go; page is 1.

    A row holds a file's whole text, so files are what bounds it.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "page_content"))), lambda x: x["page_content"]), "\n\n")
    made = pages.groupBy("source").agg(strip(text).alias("page_content"))
    return made.where("page_content <> ''").select("source", F.lit(1).alias("page"), "page_content")


def pdf_only(files: DataFrame, content: str = "content") -> DataFrame:
    """Files whose first five bytes are a PDF's."""
    return files.where(F.substring(F.col(content).cast("binary"), 1, 5) == F.lit(b"%PDF-"))


def load_counters(pages: DataFrame) -> DataFrame:
    """One row of what was read: files, pages, pages without text, characters."""
    blank = F.coalesce(strip("page_content"), F.lit("")) == ""
    return pages.agg(F.countDistinct("source").alias("files"), F.count("*").alias("pages"), F.count(F.when(blank, 1)).alias("empty_pages"), F.coalesce(F.sum(F.length("page_content")), F.lit(0)).cast("long").alias("chars"))


#: Bounds of a request.
MOST_QUESTION, MOST_TOP_K, MOST_CANDIDATES, MOST_RRF_K = 500, 20, 200, 200


def checked_requests(requests: DataFrame, modes: tuple[str, ...] = ("vector", "bm25", "hybrid"), variants: tuple[str, ...] = ("full", "no_refusal", "no_cite"), top_k: int = 4) -> DataFrame:
    """``requests(question, top_k, candidate_k, rrf_k, mode, variant)`` with defaults filled in and ``error`` (null if the request is good).

    The bounds decide first, then the mode, then the variant.
    """
    filled = requests.withColumns({"top_k": F.coalesce("top_k", F.lit(top_k)), "candidate_k": F.coalesce("candidate_k", F.lit(50)), "rrf_k": F.coalesce("rrf_k", F.lit(60)), "mode": F.coalesce("mode", F.lit("hybrid")), "variant": F.coalesce("variant", F.lit("full"))})
    outside = lambda c, most: ~F.col(c).between(1, most)
    error = (
        F.when(~F.coalesce(F.length("question").between(1, MOST_QUESTION), F.lit(False)), "question").when(outside("top_k", MOST_TOP_K), "top_k").when(outside("candidate_k", MOST_CANDIDATES), "candidate_k").when(outside("rrf_k", MOST_RRF_K), "rrf_k")
        .when(~F.col("mode").isin(*modes), "mode").when(~F.col("variant").isin(*variants), "variant")
    )
    return filled.withColumn("error", error)
