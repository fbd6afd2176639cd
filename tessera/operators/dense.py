"""Exact and clustered dense search: blocks of queries against Arrow batches of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sparse import best, top

#: Queries that are sent to the executors at once (a question set is stated and small; more go block by block), vectors that are scored at once.
QUERY_BLOCK, SLICE = 4096, 2048
FOUND = "question_id long, doc_idx long, score double"
NAMES = ["question_id", "doc_idx", "score"]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of QUERY_BLOCK queries at a time."""
    rows = iter(queries.where("embedding is not null").select("question_id", "embedding").toLocalIterator())
    while block := [r for _, r in zip(range(QUERY_BLOCK), rows, strict=False)]:
        yield np.array([r.question_id for r in block]), _unit(np.array([r.embedding for r in block], np.float64))


def _best_of(ids: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """The best k of each row of ``score`` (queries x doc)."""
    row, col = best(score, doc, k)
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(doc[col]), pa.array(score[row, col])], NAMES)


def exact(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, normalise: bool = True, strict_above: float | None = None) -> DataFrame:
    """``queries(question_id, embedding)`` x ``vectors(doc_idx, embedding)`` to (question_id, doc_idx, score, rank).

    Every slice of vectors keeps its own best k of each query, so what is shuffled is k rows a query
    and slice.  Queries are always normalised; vectors unless they were stored so.  ``threshold`` (at
    least) and ``strict_above`` are applied after the best k are chosen.  Null vectors are no candidates.
    """
    found, spark = None, vectors.sparkSession
    for block in _blocks(queries):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, q = shipped.value
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    doc, x = part.column(0).to_numpy(), _matrix(part.column(1))
                    yield _best_of(ids, doc, np.round(q @ (_unit(x) if normalise else x).T, 6), k)

        part = vectors.where("embedding is not null").select(F.col("doc_idx").cast("long"), "embedding").mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    return _cut(top(_or_empty(found, spark), k), threshold, strict_above)


def _or_empty(found: DataFrame | None, spark) -> DataFrame:
    return found if found is not None else spark.createDataFrame([], FOUND)


def _cut(ranked: DataFrame, threshold: float | None, strict_above: float | None) -> DataFrame:
    ranked = ranked if threshold is None else ranked.where(F.col("score") >= threshold)
    return ranked if strict_above is None else ranked.where(F.col("score") > strict_above)


def centroids(vectors: DataFrame, nlist: int, seed: int = 0, sample: int = 100_000) -> np.ndarray:
    """At most ``nlist`` k-means centroids of unit vectors, fitted on at most ``sample`` rows; none of an empty table."""
    vectors = vectors.where("embedding is not null")
    n = vectors.count()
    part = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64("doc_idx"), F.lit(n)) < sample)
    rows = part.orderBy("doc_idx").limit(sample).select("embedding").collect()
    if not rows:
        return np.zeros((0, 0))
    x = _unit(np.array([r.embedding for r in rows], np.float64))
    middle = x[np.random.default_rng(seed).choice(len(x), min(nlist, len(x)), replace=False)]
    for _ in range(15):
        near = (x @ middle.T).argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, x)
        middle = _unit(np.where(np.bincount(near, minlength=len(middle))[:, None] > 0, sums, middle))
    return middle


def in_cells(vectors: DataFrame, cell_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_idx, embedding, cell): unit vectors, in a row for each of their cells; ``cell_of`` takes rows to (rows x tables) cell numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1)))
                cells = cell_of(x)
                for t in range(cells.shape[1]):
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), listed, pa.array(cells[:, t].astype(np.int64))], ["doc_idx", "embedding", "cell"])

    return vectors.where("embedding is not null").select(F.col("doc_idx").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "doc_idx long, embedding array<double>, cell long")


class Clusters:
    """k-means cells; a search reads the ``nprobe`` cells nearest to the query."""

    def __init__(self, middle: np.ndarray, nprobe: int = 8):
        self.middle, self.nprobe = middle, nprobe

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.middle.T).argmax(axis=1)[:, None]

    def pick(self, q: np.ndarray) -> list[np.ndarray]:
        if not len(self.middle):
            return [np.empty(0, np.int64)] * len(q)
        score = np.round(q @ _unit(self.middle).T, 6)
        return list(np.argsort(-score, axis=1, kind="stable")[:, : self.nprobe])


class Hashes:
    """Sign codes of random directions in several tables; a search reads about ``ef`` codes, those that the query's smallest margins change.

    It stands in for a graph index, which has no place in a shuffle engine: ``ef`` trades time for recall in the same way.
    """

    def __init__(self, dim: int, bits: int, tables: int = 8, ef: int = 64, seed: int = 0):
        self.planes, self.bits, self.tables, self.ef = np.random.default_rng(seed).normal(size=(dim, tables * bits)), bits, tables, ef

    def _margins(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.planes).reshape(len(x), self.tables, self.bits)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        code = (self._margins(x) > 0) @ (1 << np.arange(self.bits))
        return code + (np.arange(self.tables) << self.bits)

    def pick(self, q: np.ndarray) -> list[np.ndarray]:
        own, margins = self.cell_of(q), np.abs(self._margins(q))
        each = max(1, self.ef // self.tables)
        free = min(self.bits, max(1, each.bit_length() + 1))
        flips = np.array(list(product((0, 1), repeat=free)))
        out = []
        for cells, m in zip(own, margins, strict=True):
            found = []
            for t in range(self.tables):
                low = np.argsort(m[t], kind="stable")[:free]
                at = np.argsort(flips @ m[t][low], kind="stable")[:each]
                found.append(cells[t] ^ (flips[at] @ (1 << low)))
            out.append(np.concatenate(found))
        return out


def probe(queries: DataFrame, cells: DataFrame, finder: Clusters | Hashes, k: int, threshold: float | None = None, strict_above: float | None = None) -> DataFrame:
    """Search of the cells that ``finder`` picks for each query: ``cells(doc_idx, embedding, cell)`` of unit vectors, as in_cells() makes them.

    Only rows of picked cells are read; a batch's rows of one cell are scored against its queries in
    one product, and keep their best k, so a large cell is many tasks' work.
    """
    found, spark = None, cells.sparkSession
    for ids, q in _blocks(queries):
        by: dict[int, list[int]] = {}
        for i, picked in enumerate(finder.pick(q)):
            for c in picked.tolist():
                by.setdefault(c, []).append(i)
        shipped = spark.sparkContext.broadcast((ids, q, by))
        wanted = F.broadcast(spark.createDataFrame([(c,) for c in by], "cell long"))  # at most the picked cells of one block

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, q, by = shipped.value
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    doc, x, cell = part.column(0).to_numpy(), _matrix(part.column(1)), part.column(2).to_numpy()
                    for c in np.unique(cell).tolist():
                        here, who = np.flatnonzero(cell == c), np.array(by[c])
                        yield _best_of(ids[who], doc[here], np.round(q[who] @ x[here].T, 6), k)

        part = cells.join(wanted, "cell", "left_semi").select("doc_idx", "embedding", "cell").mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    found = _or_empty(found, spark).groupBy("question_id", "doc_idx").agg(F.max("score").alias("score"))  # a vector may lie in several picked cells
    return _cut(top(found, k), threshold, strict_above)


def recall(truth: DataFrame, got: DataFrame) -> DataFrame:
    """One row: found share of all true (question_id, doc_idx); 0 without any."""
    hit = got.select("question_id", "doc_idx", F.lit(1).alias("hit"))
    joined = truth.select("question_id", "doc_idx").join(hit, ["question_id", "doc_idx"], "left")
    return joined.agg(F.coalesce(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), F.lit(0.0)).alias("recall"))
