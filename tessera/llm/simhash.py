"""SimHash near-duplicates found with Golay-code fuzzy keys.

Fingerprints have 64 bits, cut into segments of 23, 23 and 18.  Two fingerprints that differ in
at most three bits fall in one of three cases, by where the errors lie:

* a segment of 23 holds all three errors: the other 23 and the 18 are equal, and one exact key
  made of those two finds the pair;
* otherwise each segment of 23 has at most two errors.  Every 23-bit word has the perfect binary
  Golay code's words within distance four of it (one or six of them), and two words at distance
  two or less always share such a codeword.  Pairs of codeword indices, one per segment, are keys.

So every linked pair meets in a key; meeting pairs are verified by their real distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER_ASCII, Scratch, lean, split_join
from tessera.llm.graph import components

#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEED, MAX_ERRORS = 42, 3
#: Shingles of a text are counted this many at a time, so memory is bounded for any text.
BLOCK = 1 << 16
#: Rows of one key that a task compares; a key with more is dealt over pairs of blocks.
KEY_ROWS = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of word shingles; 0 for null, empty or blank text.

    A-Z are lower-cased, words are runs without ASCII white space, shingles of ``width`` words
    (the whole sequence if there are fewer) count as often as they occur, and a bit is set when
    it is set in more than half of the shingles' XXH64 values.
    """
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones, hash64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        part = words[i : min(i + BLOCK, n) + width - 1]
        k = max(1, len(part) - width + 1)
        flat = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[: k - 1])).tolist()
        stops = (ends[-k:] - 1).tolist()
        h = np.fromiter((hash64(flat[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, k)
        ones += np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and error patterns of weight <= 4 by syndrome (-1 pads)."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << bit - 11
        return v

    low, high = (np.array([remainder(i << s) for i in range(1 << k)], np.int32) for k, s in ((12, 0), (11, 12)))
    by: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            v = sum(1 << b for b in bits)
            by[low[v & 4095] ^ high[v >> 12]].append(v)
    return low, high, np.array([x + [-1] * (6 - len(x)) for x in by], np.int32)


def golay_indices(words: np.ndarray) -> np.ndarray:
    """For 23-bit words, the 12-bit indices of all codewords within distance four; -1 where there are fewer than six."""
    low, high, patterns = _golay()
    w = words.astype(np.int32)
    found = patterns[low[w & 4095] ^ high[w >> 12]]
    return np.where(found < 0, -1, (w[:, None] ^ found) >> 11)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (index into ``fps``, key) of every key of every fingerprint (uint64)."""
    m = np.uint64((1 << 23) - 1)
    a, b, c = fps & m, fps >> np.uint64(23) & m, fps >> np.uint64(46)
    ia, ib = golay_indices(a.astype(np.int64)), golay_indices(b.astype(np.int64))
    both = np.where((ia[:, :, None] < 0) | (ib[:, None, :] < 0), -1, ia[:, :, None].astype(np.int64) << 12 | ib[:, None, :]).reshape(len(fps), 36)
    row, col = np.nonzero(both >= 0)
    exact = [(np.uint64(tag) << np.uint64(41) | c << np.uint64(23) | s).astype(np.int64) for tag, s in ((1, a), (2, b))]
    every = np.arange(len(fps))
    return np.concatenate([row, every, every]), np.concatenate([both[row, col], *exact])


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span the components of ``fps`` under distance <= 3; memory is linear in ``fps``."""
    left, right, rest = [], [], np.arange(len(fps))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[p]) <= MAX_ERRORS
            if near.any():
                hit, rest = rest[near], rest[~near]
                left.append(np.full(len(hit), p))
                right.append(hit)
                queue.extend(hit.tolist())
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between fingerprints of each key from rows (key, fp) sorted by key; a key's rows may span batches."""
    held: list[np.ndarray] = []

    def edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, fp = rows
        a, b = [], []
        size = np.diff(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))))
        of = np.repeat(size, size)
        small = np.flatnonzero((of > 1) & (of <= 8))  # compared by shifts, all small keys at once
        for shift in range(1, 8):
            i = small[small + shift < len(key)]
            i = i[key[i] == key[i + shift]]
            i = i[np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + shift].view(np.uint64)) <= MAX_ERRORS]
            a.append(fp[i])
            b.append(fp[i + shift])
        start = np.cumsum(size) - size
        for s, n in zip(start[size > 8], size[size > 8], strict=True):
            i, j = forest(fp[s : s + n].view(np.uint64))
            a.append(fp[s + i])
            b.append(fp[s + j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if held and rows.shape[1] and rows[0, -1] == held[0][0, 0]:
            held.append(rows)
            continue
        rows = np.concatenate([*held, rows], axis=1)
        if not rows.shape[1]:
            continue
        cut = int(np.searchsorted(rows[0], rows[0, -1]))
        held = [rows[:, cut:]]
        if cut:
            yield from edges(rows[:, :cut])
    if held:
        yield from edges(np.concatenate(held, axis=1))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(0)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), *batch.columns[1:]], ["fp", *batch.schema.names[1:]])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        row, key = fuzzy_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def link_keys(keys: DataFrame, most: int = KEY_ROWS) -> DataFrame:
    """Deal rows (key, fp) so that a task compares at most about ``2 * most`` rows of a key; returns edges (a, b) of fingerprints.

    A key with more rows is split into blocks by fingerprint hash; its rows go to every pair of
    blocks that holds theirs, so each pair of rows still meets.
    """
    hot = keys.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("long").alias("blocks"))
    dealt = keys.join(hot, "key", "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other")
    dealt = dealt.select("*", other).select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"), "fp")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_links), "a long, b long")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(doc_id long, fingerprint string, component_id long, kept boolean)`` for every row of ``documents``.

    Documents link at three or fewer differing bits; ``component_id`` is the smallest doc_id (any
    long) reachable over links, and ``kept`` marks one row of each component, one of this id.  Null,
    empty and blank texts have fingerprint 0 and link like any other.  Very long texts count whole, a
    block of shingles at a time.  A null doc_id comes after all others; a component without any id has
    a null ``component_id`` and still one kept row.  Rows that share an id stay separate rows: of rows
    with the smallest id of a component one is kept.  Columns named in ``keep`` are carried along and
    come after these four (a kept column of one of their names must be renamed by the caller); others
    are ignored, whatever their names.  An empty table gives no rows.

    Equal fingerprints are one row (by aggregation) before keys are made, and within a key only a
    spanning forest leaves the task, so groups of copies cost rows in proportion to their size.  What
    is known of a fingerprint that very many rows have is brought to these rows, not they to it.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "simhash")
    carried = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep or [])]
    given = documents.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), *carried)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in given.schema[1:]]
    fps = scratch.table(given.mapInArrow(lean(_fingerprints), ", ".join(["fp long", *fields])), "fps")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rid"))
    distinct = scratch.table(fps.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "distinct")
    keys = distinct.select("fp").repartition("fp").mapInArrow(lean(_keys), "key long, fp long")
    roots = components(spark, link_keys(keys), scratch)
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    leader = member.groupBy("root").agg(F.min("first").alias("leader"))
    known = scratch.table(member.join(leader, "root").select("fp", "n", F.col("leader.doc_id").alias("component_id"), F.col("leader.rid").alias("leader")), "known")
    found = split_join(fps, known, "fp", "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("leader") == F.col("rid")).alias("kept"), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep or [])])
