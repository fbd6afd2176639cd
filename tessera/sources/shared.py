"""The folder that driver and executors share, and small facts about files."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-index-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def fingerprint(df: DataFrame) -> str:
    """Digest of names, lengths and times of the files that ``df`` reads; it changes when they do."""
    spark, said = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        p, fs = file_system(spark, name)
        s = fs.getFileStatus(p)
        said.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha1("\n".join(said).encode()).hexdigest()
