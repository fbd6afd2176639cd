"""The kept index: rows, BM25 postings, and the vectors' cells, with a manifest that is written last."""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions.text import tokens
from tessera.functions.vectors import hash_embed, l2_normalise
from tessera.operators import dense, sparse
from tessera.sources import shared

#: Backends of the vector index by name: how a finder is made of the vectors (None: every vector is scored).
BACKENDS: dict[str, Callable[[DataFrame, EngineConfig, int], dense.Clusters | dense.Hashes | None]] = {}


def backend(name: str):
    """Register a vector backend: (vectors, config, their number) to a finder with cell_of() and pick()."""

    def register(make):
        BACKENDS[name] = make
        return make

    return register


@backend("exact")
@backend("flat")
def _every(vectors: DataFrame, config: EngineConfig, n: int) -> None:
    return None


@backend("ivf")
def _clusters(vectors: DataFrame, config: EngineConfig, n: int) -> dense.Clusters:
    return dense.Clusters(dense.centroids(vectors, min(config.nlist, max(4, n // 40))), config.nprobe)


@backend("hash")
@backend("hnsw")
def _hashes(vectors: DataFrame, config: EngineConfig, n: int) -> dense.Hashes:
    first = vectors.where("embedding is not null").select(F.size("embedding").alias("n")).first()
    return dense.Hashes(first.n if first else 1, max(1, (max(1, n) // 64).bit_length()), ef=config.ef)


def resolve(name: str):
    """The backend of this name; an unknown one raises."""
    if name not in BACKENDS:
        raise ValueError(f"unknown index {name!r}; one of {sorted(BACKENDS)}")
    return BACKENDS[name]


@dataclass
class Index:
    """An opened index: ``rows`` (with doc_idx, page_content, embedding), ``postings``, ``cells`` (None without cells)."""

    path: str
    about: dict
    rows: DataFrame
    postings: DataFrame
    cells: DataFrame | None
    finder: object = field(repr=False)

    def vectors(self, queries: DataFrame, k: int, nprobe: int | None = None, threshold: float | None = None) -> DataFrame:
        """The best k of each query by inner product; cells are searched if the index has any."""
        if self.cells is None:
            return dense.exact(queries, self.rows.select("doc_idx", "embedding"), k, threshold, normalise=not self.about["normalized"])
        if nprobe is not None:
            setattr(self.finder, "nprobe" if isinstance(self.finder, dense.Clusters) else "ef", nprobe)
        return dense.probe(queries, self.cells, self.finder, k, threshold)

    def terms(self, questions: DataFrame, k: int, tokenizer=tokens) -> DataFrame:
        return sparse.search_packed(questions, self.postings, self.about["n_docs"], self.about["avgdl"], k, tokenizer=tokenizer)


def build(spark: SparkSession, docs: DataFrame, path: str, config: EngineConfig | None = None, embed=hash_embed, tokenizer=tokens, **about) -> Index:
    """Write the index of ``docs(doc_idx, page_content, ...)``, which may bring an ``embedding``; then open it."""
    c = config or EngineConfig()
    make = resolve(c.index)
    shared.remove(spark, path)
    rows = docs if "embedding" in docs.columns else embed(docs, "page_content")
    if c.ingest_normalize:
        rows = rows.withColumn("embedding", l2_normalise(F.col("embedding")))
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    n = rows.count()
    sparse.packed(rows.select("doc_idx", "page_content"), tokenizer, n).write.parquet(f"{path}/postings")
    tokens_in = spark.read.parquet(f"{path}/postings").agg(F.sum(F.aggregate("docs", F.lit(0).cast("long"), lambda s, x: s + x["tf"]))).first()[0] or 0
    finder = make(rows.select("doc_idx", "embedding"), c, n)
    if finder is not None:
        dense.in_cells(rows.select("doc_idx", "embedding"), finder.cell_of).repartition("cell").sortWithinPartitions("cell").write.parquet(f"{path}/cells")
    first = rows.where("embedding is not null").select(F.size("embedding").alias("n")).first()
    said = {"index": c.index, "nlist": c.nlist, "normalized": c.ingest_normalize, "count": n, "dim": first.n if first else 0, "n_docs": n, "avgdl": tokens_in / n if n else 0.0, "finder": base64.b64encode(pickle.dumps(finder)).decode(), **about}
    spark.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return load(spark, path)


def manifest(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(f"{path}/manifest").first().value) if shared.exists(spark, f"{path}/manifest") else None


def load(spark: SparkSession, path: str) -> Index:
    """Open an index; one without a manifest is none.  The manifest is this engine's own writing and is trusted as code is."""
    about = manifest(spark, path)
    if about is None:
        raise FileNotFoundError(f"no index at {path}")
    finder = pickle.loads(base64.b64decode(about["finder"]))
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(path, about, read("rows"), read("postings"), read("cells") if finder is not None else None, finder)


def load_or_build(spark: SparkSession, docs: DataFrame, path: str, config: EngineConfig | None = None, **given) -> Index:
    """The index at ``path`` if its type, its cells' number and what else is stated of it (a fingerprint, say) agree; else a new one."""
    c = config or EngineConfig()
    about = manifest(spark, path)
    wanted = {"index": c.index, "nlist": c.nlist, "normalized": c.ingest_normalize} | {k: v for k, v in given.items() if k not in ("embed", "tokenizer")}
    if about is not None and all(about.get(k) == v for k, v in wanted.items()):
        return load(spark, path)
    return build(spark, docs, path, c, **given)


def add(spark: SparkSession, docs: DataFrame, path: str, embed=hash_embed, tokenizer=tokens) -> Index:
    """Append new rows: their vectors go to the cells that are there; postings, whose document frequencies all change, are written anew."""
    at = load(spark, path)
    known = at.rows.select("doc_idx")
    fresh = docs.join(known, "doc_idx", "left_anti")
    fresh = fresh if "embedding" in fresh.columns else embed(fresh, "page_content")
    if at.about["normalized"]:
        fresh = fresh.withColumn("embedding", l2_normalise(F.col("embedding")))
    had = at.about["count"]
    fresh.select(*at.rows.columns).write.mode("append").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    n = rows.count()
    if n != had and at.finder is not None:
        dense.in_cells(rows.join(at.cells.select("doc_idx").distinct(), "doc_idx", "left_anti").select("doc_idx", "embedding"), at.finder.cell_of).write.mode("append").parquet(f"{path}/cells")
    shared.remove(spark, f"{path}/postings")
    sparse.packed(rows.select("doc_idx", "page_content"), tokenizer, n).write.parquet(f"{path}/postings")
    tokens_in = spark.read.parquet(f"{path}/postings").agg(F.sum(F.aggregate("docs", F.lit(0).cast("long"), lambda s, x: s + x["tf"]))).first()[0] or 0
    about = at.about | {"count": n, "n_docs": n, "avgdl": tokens_in / n if n else 0.0}
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return load(spark, path)
