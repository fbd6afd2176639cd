"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A vector is turned by a random rotation and cut into blocks; each block has a code of random
directions, and a filter is one direction from every block's code.  A vector's filters are all
those whose cap it lies in, that is whose summed inner products exceed a threshold (list decoding:
blocks are searched in turn, nothing else is enumerated), and its ``least`` best ones in any case.
Vectors join on filters and every meeting pair is verified by its cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lean, split_join
from tessera.llm.graph import components

COSINE = 0.95
#: Blocks, directions in a block's code, cap threshold in deviations of a random vector, fewest filters of a vector.
BLOCKS, CODE, DEVIATIONS, LEAST = 2, 256, 3.4, 16
#: Rows of one filter that a task compares with as many others; a filter with more is dealt over pairs of parts.
FILTER_ROWS = 2048
SEED = 20


@lru_cache(8)
def _codes(dim: int, blocks: int, code: int) -> tuple[np.ndarray, list[np.ndarray]]:
    r = np.random.Generator(np.random.PCG64([SEED, dim, blocks, code]))
    turn, _ = np.linalg.qr(r.normal(size=(dim, dim)))
    books = []
    for part in np.array_split(np.arange(dim), blocks):
        c = r.normal(size=(code, len(part)))
        books.append(c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None])
    return turn, books


def filters(x: np.ndarray, blocks: int = BLOCKS, code: int = CODE, deviations: float = DEVIATIONS, least: int = LEAST) -> list[np.ndarray]:
    """Ascending filter numbers of each row of ``x`` (unit vectors of one dimension)."""
    n, dim = x.shape
    blocks = min(blocks, dim)
    turn, books = _codes(dim, blocks, code)
    y, at, dots = x @ turn, 0, []
    for book in books:
        dots.append(y[:, at : at + book.shape[1]] @ book.T)
        at += book.shape[1]
    best = [d.max(axis=1) for d in dots]
    limit = deviations * np.sqrt(blocks / dim)
    out = []
    for i in range(n):
        found = _decode([d[i] for d in dots], [b[i] for b in best], limit)
        room = code**blocks
        while len(found[0]) < min(least, room):
            limit_i = (found[2] if len(found) > 2 else limit) - 0.15 * np.sqrt(blocks / dim)
            found = (*_decode([d[i] for d in dots], [b[i] for b in best], limit_i), limit_i)
        numbers, sums = found[:2]
        strong = sums > limit
        if strong.sum() < least:
            keep = np.lexsort((numbers, -sums))[:least]
            numbers = numbers[keep]
        out.append(np.sort(numbers))
    return out


def _decode(dots: list[np.ndarray], best: list[float], limit: float) -> tuple[np.ndarray, np.ndarray]:
    """All products of directions whose sum exceeds ``limit``; prefixes that can't reach it are dropped."""
    numbers, sums, rest = np.zeros(1, np.int64), np.zeros(1), sum(best)
    for d, b in zip(dots, best, strict=True):
        rest -= b
        row, col = np.nonzero(sums[:, None] + d[None, :] + rest > limit)
        numbers, sums = numbers[row] * len(d) + col, sums[row] + d[col]
    return numbers, sums


def _narrow(blocks: int, code: int):
    return np.uint16 if code**blocks <= 1 << 16 else np.uint32 if code**blocks <= 1 << 32 else np.int64


def _listed(blocks: int, code: int, deviations: float, least: int):
    """Rows (node, copies, v) to (key, node, copies, v, others), a row for each filter; ``others`` are the vector's filters, ascending, in the narrowest type."""
    narrow = _narrow(blocks, code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, copies = (batch[c].to_numpy() for c in ("node", "copies"))
            cells = [_scaled(np.array(v.as_py(), np.float64)) for v in batch["v"]]
            by: dict[int, list[int]] = {}
            for i, v in enumerate(cells):
                by.setdefault(len(v), []).append(i)
            for dim, rows in by.items():
                for k in range(0, len(rows), 1024):
                    part = rows[k : k + 1024]
                    x = np.stack([cells[i] for i in part])
                    lists = filters(x / np.linalg.norm(x, axis=1)[:, None], blocks, code, deviations, least)
                    of = np.repeat(part, [len(f) for f in lists])
                    raw = [_packed(cells[i]) for i in part]
                    every = [f.astype(narrow).tobytes() for f in lists]
                    number = np.repeat(np.arange(len(part)), [len(f) for f in lists])
                    key = np.concatenate(lists) + (dim << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nodes[of]), pa.array(copies[of]), pa.array([raw[j] for j in number], pa.binary()), pa.array([every[j] for j in number], pa.binary())], ["key", "node", "copies", "v", "others"])

    return run


def _scaled(v: np.ndarray) -> np.ndarray:
    """``v`` by its largest part's power of two, so that no square is too large or small; cosines stay the same to the bit or nearly."""
    return np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))


def _packed(v: np.ndarray) -> bytes:
    """As single precision where nothing is lost (vectors stored so), else in double."""
    single = v.astype(np.float32)
    return b"f" + single.tobytes() if (single == v).all() else b"d" + v.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if raw[:1] == b"f" else np.float64, offset=1).astype(np.float64)


def _first_common(number: int, left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Of ``pairs`` (rows i, j), those that share no filter below ``number``: so that each pair counts once."""
    seen = np.unique(np.concatenate([f[f < number] for f in left + right]))
    if not len(seen) or not len(pairs):
        return pairs

    def bits(lists: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(lists), -(-len(seen) // 64)), np.uint64)
        for i, f in enumerate(lists):
            at = np.searchsorted(seen, f[f < number])
            np.bitwise_or.at(out[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return out

    a, b = bits(left), bits(right)
    keep = np.concatenate([~(a[p[:, 0]] & b[p[:, 1]]).any(axis=1) for p in np.array_split(pairs, max(1, len(pairs) // 100_000))])
    return pairs[keep]


def _compared(cosine: float, narrow):
    """Rows of keys (key, i, j), sorted, to (a, b, n): links counted (b null) and edges that span the linked rows (n zero)."""

    def compare(rows: list[tuple]) -> Iterator[tuple[list, list, list]]:
        key, part_i, part_j = rows[0][:3]
        x = np.stack([_unpacked(r[6]) for r in rows])
        x /= np.linalg.norm(x, axis=1)[:, None]
        mine = np.array([r[3] for r in rows])
        left, right = np.flatnonzero(mine == part_i), np.flatnonzero(mine == part_j)
        lists = [np.frombuffer(r[7], narrow).astype(np.int64) for r in rows]
        copies, node = np.array([r[5] for r in rows]), np.array([r[4] for r in rows])
        close = x[left] @ x[right].T >= cosine
        if part_i == part_j:
            close = np.triu(close, 1)
        pairs = np.argwhere(close)
        if not len(pairs):
            return
        pairs = _first_common(key & ((1 << 40) - 1), [lists[i] for i in left], [lists[j] for j in right], pairs)
        a, b = left[pairs[:, 0]], right[pairs[:, 1]]
        links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
        some = np.flatnonzero(links)
        yield node[some].tolist(), [None] * len(some), links[some].astype(int).tolist()
        root = np.arange(len(rows))  # edges of a spanning forest, by hooking each row to the smallest of its component
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(root != np.arange(len(rows)))
        yield node[some].tolist(), node[root[some]].tolist(), [0] * len(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                for a, b, n in compare(held):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

        for batch in batches:
            for r in zip(*(batch[c].to_pylist() for c in ("key", "i", "j", "mine", "node", "copies", "v", "others")), strict=True):
                if held and held[0][:3] != r[:3]:
                    yield from done()
                    held = []
                held.append(r)
        yield from done()

    return run


def near_duplicates(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, blocks: int = BLOCKS, code: int = CODE, deviations: float = DEVIATIONS, least: int = LEAST, most: int = FILTER_ROWS) -> DataFrame:
    """``(vec_id long, n_links long, component_id long, kept boolean)`` for every row of ``embeddings``.

    ``n_links`` counts the other rows found at ``cosine`` or above (none below counts),
    ``component_id`` is the smallest vec_id (any long) reachable over links, ``kept`` says it is the
    row's own.  Vectors that are null, empty or zero or hold null or non-finite parts link with
    nothing, nor do vectors of different dimension; finite parts may be of any size.  Equal vectors are
    one row until the end, so copies cost nothing.  Rows that share a vec_id separately link, and all
    that is reachable from one of them or another by links alone is a component; a row with a null
    vec_id has its links counted, never names a component (null if no row of it has an id) and isn't
    kept.  Other columns, labels among them, are ignored, whatever their names; an empty table gives
    no rows.  Vectors have one dimension's length, so no row is longer than its table's dimension.

    A filter's rows beyond ``most`` are dealt over pairs of parts, so no task gathers a hot filter.
    """
    spark: SparkSession = embeddings.sparkSession
    scratch = Scratch(spark, "caps")
    given = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    given = scratch.table(given.withColumn("good", F.coalesce(usable, F.lit(False))), "rows")
    classes = given.where("good").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    listed = nodes.select("node", "copies", "v").repartition("node").mapInArrow(lean(_listed(blocks, code, deviations, least)), "key long, node long, copies long, v binary, others binary")
    listed = scratch.table(listed, "filters")
    hot = listed.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("long").alias("parts"))
    dealt = listed.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), "parts"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")).select("key", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "mine", "node", "copies", "v", "others")
    found = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(_compared(cosine, _narrow(blocks, code))), "a long, b long, n long")
    found = scratch.table(found, "found")
    scratch.drop("filters")
    roots = components(spark, found.where("b is not null").select("a", "b"), scratch)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    about = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = about.groupBy("root").agg(F.min("rep").alias("component_id"))
    about = about.join(named, "root").join(links, "node", "left")
    about = scratch.table(about.select("v", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "about")
    good = split_join(given.where("good"), about, "v", "copies").select("vec_id", "n_links", "component_id")
    rest = given.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
