"""Mix sources to target weights from fixed-length token blocks.

Every source's documents are laid end to end and cut into blocks of ``block`` tokens.  Each output
shard draws multinomial counts of the sources; the draws of a source, numbered over all shards, are
slots.  A pseudorandom permutation of the source's block indices, one for each pass over it, maps
slots to blocks, and blocks are joined by index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORDS, Scratch, lean

#: Weights of the sources by their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Tokens in a block, blocks in an output shard, most passes over a source.
BLOCK, SHARD_BLOCKS, PASSES, SEED = 64, 4096, 3, 17
#: Most sources, and most bytes of their names, that the driver lists and broadcasts.
MOST_SOURCES, MOST_NAMES = 1_000_000, 64 << 20
#: Shards whose counts one window task sums up.
STRETCH = 4096


def targets(sizes: list[float], weights: list[float], most: float = PASSES) -> list[float]:
    """Share the total of ``sizes`` by weight; none above ``most`` times its size, the excess reshared by weight until none is."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        scale = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * scale > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * scale
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in full]
    return out


def _generator(*parts) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:16], "big")))


def shard_counts(shard: int, quota: np.ndarray, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> np.ndarray:
    """A multinomial draw of how many blocks each source gives to one output shard; the last shard is shorter."""
    total = int(quota.sum())
    return _generator(seed, "shard", shard).multinomial(min(shard_blocks, total - shard * shard_blocks), quota / total)


class Settled:
    """Slots as drawn to slots within the quotas.

    The draws of a source over all shards may come to more or less than its quota.  What is beyond
    the quotas, in the order of sources and slots, fills what the others lack, in their order.
    """

    def __init__(self, quota: np.ndarray, drawn: np.ndarray):
        over, lack = np.maximum(drawn - quota, 0), np.maximum(quota - drawn, 0)
        self.quota, self.drawn = quota, drawn
        self.before, self.fill = np.cumsum(over) - over, np.cumsum(lack)

    def __call__(self, source: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source and slot of each drawn ``slot`` of ``source``."""
        k = self.before[source] + slot - self.quota[source]
        moved = slot >= self.quota[source]
        to = np.where(moved, np.searchsorted(self.fill, k, "right"), source)
        lack = np.maximum(self.quota - self.drawn, 0)[to]
        return to, np.where(moved, self.drawn[to] + k - (self.fill[to] - lack), slot)


def permute(index: np.ndarray, size: int, key: str) -> np.ndarray:
    """Pseudorandom permutation of range(size): a four-round Feistel network, walked until it falls inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = np.frombuffer(hashlib.sha256(key.encode()).digest(), np.uint64)

    def step(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in rounds:
            x = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (x >> np.uint64(32)) & mask
        return left << np.uint64(half) | right

    out = step(index.astype(np.uint64))
    while (outside := out >= size).any():
        out[outside] = step(out[outside])
    return out.astype(np.int64)


def _draws(shipped, shard_blocks: int, seed: int):
    """Shard numbers to rows (shard, source_no, n) of what each shard draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quota = shipped.value
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = shard_counts(shard, quota, shard_blocks, seed)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(some), pa.array(n[some])], ["shard", "source_no", "n"])

    return run


def _slots(shipped, seed: int):
    """Rows (shard, source_no, first, n) to rows (source_no, shard, slot, pass, block_no)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quota, drawn, n_blocks = shipped.value
        settled = Settled(quota, drawn)
        for batch in batches:
            for shard, source, first, n in zip(*(batch[c].to_pylist() for c in ("shard", "source_no", "first", "n")), strict=True):
                to, slot = settled(source, np.arange(first, first + n))
                turn, at = slot // n_blocks[to], slot % n_blocks[to]
                block = np.empty_like(slot)
                for i, t in np.unique(np.stack([to, turn]), axis=1).T.tolist():
                    here = (to == i) & (turn == t)
                    block[here] = permute(at[here], int(n_blocks[i]), f"{seed} {i} {t}")
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(n, shard)), pa.array(slot), pa.array(turn), pa.array(block)], ["source_no", "shard", "slot", "pass", "block_no"])

    return run


def mix(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, most: int = PASSES, seed: int = SEED, most_sources: int = MOST_SOURCES) -> tuple[DataFrame, DataFrame]:
    """The mixture, and each document's part in it.

    Returns ``(blocks, parts)``.  ``blocks`` has a row for each document span of each chosen slot:
    ``shard, slot, pass, source, block_no, doc_no, doc_id, from_word, n_words`` (word offsets in the
    document).  ``parts`` has a row for each document row: ``doc_no, doc_id, source, size,
    source_size, target, taken``; ``doc_no`` is the row's place in its source.

    Size is the number of words (runs without ASCII white space) of the whole text, however long;
    null, empty and blank texts have 0, get target shares like any document of their source, and are
    never taken.  Sources sort by code point with null last, and weigh ``weights`` in turn.  Within a
    source rows go by a hash of id and text, then id; a null id is a value like any other.  Rows that
    are the same in all of these are separate documents, one after the other, and as good as each
    other.  Other columns are ignored, whatever their names; an empty table gives no rows.  Reruns on
    the same rows agree, whatever the partitioning: order and draws depend on values and ``seed`` only.

    Rows are dealt by ranges of the order for prefix sums, so a source, or a row, with a third of all
    rows is many tasks' work.  The driver lists the sources, at most ``most_sources`` and MOST_NAMES
    bytes of names (more are an error); shards are drawn on the executors.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("tie"))
    sized = scratch.table(sized, "sizes")
    sources = scratch.table(sized.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    count, names = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    if count > most_sources or names > MOST_NAMES:
        raise ValueError(f"{count} sources with {names} bytes of names are more than the driver lists")
    listed = sources.collect()
    listed.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be", "surrogatepass")))
    aims = targets([r["size"] for r in listed], [weights[i % len(weights)] for i in range(len(listed))], most)
    n_blocks = [-(-r["size"] // block) for r in listed]
    quota = np.array([min(most * b, round(a / (r["size"] / b))) if b else 0 for r, a, b in zip(listed, aims, n_blocks, strict=True)], np.int64)
    about = spark.createDataFrame([(i, r.source, r["size"], a) for i, (r, a) in enumerate(zip(listed, aims, strict=True))], "source_no long, source string, source_size long, target double")

    order = ["source_no", "tie", "doc_id", "size", "rid"]
    numbered = sized.withColumn("rid", F.monotonically_increasing_id()).alias("s").join(F.broadcast(about).alias("a"), F.col("s.source").eqNullSafe(F.col("a.source"))).select("s.*", "source_no", "source_size", "target")
    dealt = scratch.table(numbered.repartitionByRange(deal, *order).withColumn("part", F.spark_partition_id()), "dealt")
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("source_no", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))  # a row for each part and source in it
    bases = bases.select("source_no", "part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_no"))
    inside = Window.partitionBy("source_no", "part").orderBy(*order[1:])
    at = F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    laid = dealt.join(bases, ["source_no", "part"]).select("*", at.alias("at"), (F.col("base_no") + F.row_number().over(inside) - 1).alias("doc_no"))
    laid = scratch.table(laid.select("doc_no", "doc_id", "source", "size", "source_size", "target", "source_no", "at"), "laid")

    shards = -(-int(quota.sum()) // shard_blocks)
    draws = spark.range(0, shards, 1, max(1, min(shards, deal))).mapInArrow(lean(_draws(spark.sparkContext.broadcast(quota), shard_blocks, seed)), "shard long, source_no long, n long")
    draws = scratch.table(draws.withColumn("stretch", F.floor(F.col("shard") / STRETCH)), "draws")
    drawn = np.zeros(len(listed), np.int64)
    for r in draws.groupBy("source_no").agg(F.sum("n").alias("n")).collect():
        drawn[r.source_no] = r.n
    over = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = draws.groupBy("source_no", "stretch").agg(F.sum("n").alias("b")).select("source_no", "stretch", F.coalesce(F.sum("b").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "stretch").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    slots = draws.join(bases, ["source_no", "stretch"]).select("shard", "source_no", (F.col("base") + F.sum("n").over(inside) - F.col("n")).alias("first"), "n")
    shipped = spark.sparkContext.broadcast((quota, drawn, np.array(n_blocks, np.int64)))
    slots = slots.repartition(deal, "source_no", "shard").mapInArrow(lean(_slots(shipped, seed)), "source_no long, shard long, slot long, pass long, block_no long")

    b = F.lit(block)
    spans = laid.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))).alias("block_no"))
    begin, end = F.greatest(F.col("at"), F.col("block_no") * b), F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * b)
    spans = spans.select("source_no", "source", "block_no", "doc_no", "doc_id", (begin - F.col("at")).alias("from_word"), (end - begin).alias("n_words"))
    # a slot row comes of many times smaller input, so its size is underrated: neither side is to be broadcast
    blocks = slots.hint("merge").join(spans, ["source_no", "block_no"]).drop("source_no")
    # block use is counted before the join, which then meets each block once however often it is drawn
    uses = slots.groupBy("source_no", "block_no").count()
    taken = spans.join(uses.hint("merge"), ["source_no", "block_no"]).groupBy("source_no", "doc_no").agg(F.sum(F.col("n_words") * F.col("count")).alias("taken"))
    parts = laid.join(taken, ["source_no", "doc_no"], "left").select("doc_no", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return blocks, parts
