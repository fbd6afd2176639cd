"""Vectors as arrays: norms and products as columns, text to hashed vectors by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column, eps: float = 1e-12) -> Column:
    """Over its norm, which is worked out once a vector (bound as the one element of an array)."""
    parts = v.cast("array<double>")
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(parts, lambda x: x / F.greatest(n, F.lit(eps)))), 1)


def cosine(a: Column, b: Column) -> Column:
    """Null if either is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def hash_embed(df: DataFrame, text: str, out: str = "embedding", dim: int = DIM) -> DataFrame:
    """Adds the unit vector of summed code points / 256 at position modulo ``dim`` of the lower-cased text; zeros for none."""
    names, schema = df.columns, df.schema
    frame = df.select(F.lower(F.col(text)).alias("_t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, dim))
            for i, cell in enumerate(batch.column(0)):
                t = cell.as_py()
                if t:
                    code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                    rows[i] = np.bincount(np.arange(len(code)) % dim, code, dim) / 256
            rows /= np.maximum(np.sqrt((rows * rows).sum(axis=1)), 1e-12)[:, None]
            cells = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dim, pa.int32()), pa.array(rows.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], cells], [*batch.schema.names[1:], "v"])

    made = frame.mapInArrow(run, ", ".join([*[f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(schema)], "v array<double>"]))
    return made.toDF(*names, out)
