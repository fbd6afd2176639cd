"""Helpers shared by the operators: scratch tables, temporary settings, shared patterns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Byte table that lower-cases A-Z and leaves every other byte (hence all of UTF-8) alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made in local mode; on a cluster that is an
    error, since executors would write to folders that no other machine sees.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _FALLBACK:
            _FALLBACK.append(tempfile.mkdtemp(prefix="tessera-"))
        found = _FALLBACK[0]
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Set Spark SQL options (``_`` stands for ``.``) for a block and restore them after."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of an Arrow batch: texts may be long, and the JVM and Python both hold a batch.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to BATCH_ROWS rows, if they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release_memory() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which a Python worker that goes on to other tasks keeps nothing of this one."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


#: Shuffle files of a finished scratch write go at once rather than when the driver's heap is next collected.
TIDY = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_OPEN: list[Scratch] = []


@contextlib.contextmanager
def finished():
    """Results of operators called in this block are used up at its end: their scratch tables go."""
    before = set(map(id, _OPEN))
    try:
        yield
    finally:
        for scratch in [x for x in _OPEN if id(x) not in before]:
            scratch.close()


class Scratch:
    """Tables written to the shared folder so that later steps survive a lost executor.

    ``table`` writes and rereads a DataFrame; ``drop`` removes one that no later step reads.
    Tables still needed by the lazily evaluated result are removed at the end of a ``finished``
    block around the operator and the use of its result, or else when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        small_batches(spark)
        _OPEN.append(self)
        atexit.register(self.close)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with settings(self.spark, **TIDY):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A table hash-bucketed on ``key``: joins on it move only the other side."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        full = f"tessera_{name}_{uuid.uuid4().hex}"
        with settings(self.spark, **TIDY):
            (df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", f"{self.root}/{name}").format("parquet").saveAsTable(full))
        self.tables.append(full)
        return self.spark.table(full)

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        atexit.unregister(self.close)
        if self in _OPEN:
            _OPEN.remove(self)
        with contextlib.suppress(Exception):
            for t in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        _remove(self.spark, self.root)


#: Keys with more rows than the first number, and than their even share of the second, are hot: so there are at most that many.
HOT_ROWS, HOT_KEYS = 2048, 10_000


def split_join(left: DataFrame, right: DataFrame, key: str, count: str, least: int = HOT_ROWS) -> DataFrame:
    """Inner join with ``right``, which has one row a key and in ``count`` how many rows of ``left`` have it.

    The rows of hot keys stay where they are: their part of ``right``, at most HOT_KEYS rows, is
    broadcast.  The others are joined as usual.  Both sides are read twice, so they should be tables.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(least, total // HOT_KEYS)
    few = F.broadcast(right.where(hot))
    return left.join(few, key).unionByName(left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(right.where(~hot), key))


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def crc_fold(doc_id, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
