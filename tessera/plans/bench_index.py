"""How fast and how complete the vector indexes are, at each size."""

from __future__ import annotations

import shutil
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.config import EngineConfig
from tessera.operators import dense, index
from tessera.sources.tables import invented_vectors, noisy_copies

#: Probed cells and codes.
NPROBE, EF = (1, 8, 32), (16, 64, 256)


def timed(run: Callable[[], object], repeats: int = 3) -> float:
    """Mean seconds of ``repeats`` calls after one to warm up."""
    run()
    began = time.perf_counter()
    for _ in range(repeats):
        run()
    return (time.perf_counter() - began) / repeats


def one_size(vectors: DataFrame, queries: DataFrame, k: int = 4, repeats: int = 1, nprobe: tuple[int, ...] = NPROBE, ef: tuple[int, ...] = EF) -> list[dict]:
    """Rows (method, param, build_sec, latency_ms_per_query, recall_at_k) of exact search, k-means cells and hash codes.

    Cells are min(256, max(4, n // 40)); more probes than cells are left out.
    """
    n, asked = vectors.count(), max(1, queries.count())
    truth = dense.exact(queries, vectors, k).cache()
    out = []

    def row(method: str, param: str, build: float, search: Callable[[], DataFrame]) -> None:
        seconds = timed(lambda: search().write.format("noop").mode("overwrite").save(), repeats)
        out.append({"method": method, "param": param, "build_sec": round(build, 3), "latency_ms_per_query": round(1000 * seconds / asked, 4), "recall_at_k": dense.recall(truth, search()).first().recall})

    row("exact", "-", 0.0, lambda: dense.exact(queries, vectors, k))
    nlist = min(256, max(4, n // 40))
    for method in ("ivf", "hash"):
        began = time.perf_counter()
        finder = index.resolve(method)(vectors, EngineConfig(nlist=nlist), n)
        cells = dense.in_cells(vectors, finder.cell_of).cache()
        cells.count()
        build = time.perf_counter() - began
        for v in nprobe if method == "ivf" else ef:
            if method == "ivf" and v > nlist:
                continue
            setattr(finder, "nprobe" if method == "ivf" else "ef", v)
            row(method, f"nprobe={v}" if method == "ivf" else f"ef={v}", build, lambda: dense.probe(queries, cells, finder, k))
        cells.unpersist()
    truth.unpersist()
    return out


def benchmark(spark: SparkSession, sizes: list[int], dim: int = 64, queries: int = 20, k: int = 4, repeats: int = 1, stored: DataFrame | None = None) -> list[dict]:
    """one_size() at each size: invented vectors, or noisy copies of ``stored`` ones (queries noised too)."""
    out = []
    for n in sizes:
        folder = tempfile.mkdtemp()
        try:
            made = invented_vectors(spark, n, dim) if stored is None else noisy_copies(stored, n)
            made.write.mode("overwrite").parquet(f"{folder}/v")
            vectors = spark.read.parquet(f"{folder}/v")
            asked = (invented_vectors(spark, queries, dim, 1) if stored is None else noisy_copies(stored, queries, seed=1)).withColumnRenamed("doc_idx", "question_id")
            out += [{"mode": "synth" if stored is None else "corpus", "n": n} | r for r in one_size(vectors, asked, k, repeats)]
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    return out
