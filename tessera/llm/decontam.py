"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lean

#: Bytes of normal text: a-z, 0-9 and all non-ASCII as they are, A-Z lower-cased, the rest white space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WINDOW = 13
#: Most nodes of the automaton that a worker holds, some 50 bytes each; a larger benchmark is read in further passes.
MOST_NODES = 1 << 20
#: Items are cut into overlapping pieces of so many words, which are dealt to the passes.
PIECE = 2048


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def windows(found: list[bytes], width: int = WINDOW) -> set[tuple[bytes, ...]]:
    """Windows of ``width`` consecutive words; fewer words, but not none, are one window."""
    return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


class Automaton:
    """Aho-Corasick automaton over word numbers; its patterns are the items' windows."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = WINDOW):
        by: dict[tuple[bytes, ...], set[int]] = {}
        for item, text in items:
            for w in windows(words(text), width):
                by.setdefault(w, set()).add(item)
        self.numbers: dict[bytes, int] = {}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if by else None
        for w, ids in by.items():
            self.found.add_word(tuple(self.numbers.setdefault(x, len(self.numbers) + 1) for x in w), (len(w), tuple(x for x in ids if x is not None)))
        if by:
            self.found.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged word spans [from, to) that windows cover, ids of the items hit."""
        said = words(text)
        spans: list[list[int]] = []
        ids: set[int] = set()
        if self.found is None or self.numbers.keys().isdisjoint(said):
            return len(said), [], ids
        for end, (n, items) in self.found.iter(tuple(self.numbers.get(w, 0) for w in said)):
            first = end - n + 1
            ids.update(items)
            while spans and spans[-1][0] >= first:  # a longer window that ends here begins before
                n = max(n, spans.pop()[1] - first)
            if spans and first <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], first + n)
            else:
                spans.append([first, first + n])
        return len(said), [(a, b) for a, b in spans], ids


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans of the normal text as code-point spans [from, to) of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).tolist()  # where words begin and end, in turn
    out, at, point = [], 0, 0
    for i in (x for a, b in spans for x in (edges[2 * a], edges[2 * b - 1])):
        point, at = point + len(raw[at:i].decode("utf-8", "surrogatepass")), i
        out.append(point)
    return list(zip(out[::2], out[1::2], strict=True))


_SPAN = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _scanner(part, width: int, first: bool, last: bool):
    """part: a broadcast, pickled list of (id, text).  Later passes find ``spans`` and ``items`` of earlier ones beside the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(pickle.loads(part.value), width)
        for batch in batches:
            counts, all_spans, all_items, offsets = [], [], [], []
            earlier = [] if first else [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()]
            for i, cell in enumerate(batch.column(0 if first else 3)):
                text = cell.as_py()
                n, spans, ids = auto.scan(text)
                if earlier:
                    spans, ids = merge(spans + [(x["from"], x["to"]) for x in earlier[1][i]]), ids | set(earlier[2][i])
                counts.append(n)
                all_spans.append([{"from": a, "to": b} for a, b in spans])
                all_items.append(sorted(ids))
                offsets.append([{"from": a, "to": b} for a, b in original_offsets(text, spans)] if last and spans else [])
            names = batch.schema.names[0 if first else 3 :]
            rest = dict(zip(names, batch.columns[0 if first else 3 :], strict=True))
            if last:
                del rest["_t"]
                rest = {"_o": pa.array(offsets, _SPAN)} | rest
            made = {"_n": pa.array(counts, pa.int64()), "_s": pa.array(all_spans, _SPAN), "_i": pa.array(all_items, pa.list_(pa.int64()))} | rest
            yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _pieces(width: int):
    """Rows (id, text) to (id, piece, nodes): overlapping pieces of an item's words, with the nodes they can make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = words(cell.as_py())
                for at in range(0, max(1, len(w) - width + 1), PIECE) if w else ():
                    part = w[at : at + PIECE + width - 1]
                    out.append((i, b" ".join(part).decode("utf-8", "surrogatepass"), max(1, len(part) - width + 1) * min(width, len(part))))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], ["i", "t", "nodes"])

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, most_nodes: int = MOST_NODES) -> DataFrame:
    """Scan every whole text once for every window of the benchmark's items.

    Returns the columns named in ``keep`` (all but clashing ones by default), then ``n_words
    long``, ``n_hit long``, ``n_items long``, ``items array<long>``, ``spans`` (merged word spans)
    and ``offsets`` (the same as code-point spans of the original text).  A text without words (or
    null) has no hits; very long texts are scanned whole.  Items without words match nothing; an item
    that occurs twice counts once; an item with a null id marks words but isn't listed.  Repeated
    rows and rows that share an id are scanned alike; there are no ties.  Other columns are ignored,
    whatever their names.  Either table may be empty.

    The automaton's size is bounded: up to ``most_nodes`` nodes are held at once; a larger benchmark
    is dealt over several passes, each with an automaton within the bound (but for a single piece of
    PIECE windows), whose spans and items are merged.
    """
    spark: SparkSession = documents.sparkSession
    made = {"n_words", "n_hit", "n_items", "items", "spans", "offsets"}
    keep = [c for c in documents.columns if c not in made] if keep is None else keep
    scratch = Scratch(spark, "decontam")
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    items = scratch.table(items.mapInArrow(lean(_pieces(width)), "i long, t string, nodes long").distinct(), "items")
    count, nodes, widest = items.agg(F.count("*"), F.coalesce(F.sum("nodes"), F.lit(0)), F.coalesce(F.max("nodes"), F.lit(0))).first()
    passes = max(1, -(-nodes // most_nodes))
    dealt = lambda n: F.pmod(F.xxhash64("i", "t"), F.lit(n))
    while passes > 1 and passes < count and items.groupBy(dealt(passes)).agg(F.sum("nodes").alias("nodes")).agg(F.max("nodes")).first()[0] > max(most_nodes, widest):
        passes = min(count, passes * 2)
    frame = documents.select(F.col(text).alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema]
    span = "array<struct<`from`:bigint,`to`:bigint>>"
    for k in range(passes):
        group = items if passes == 1 else items.where(dealt(passes) == k)
        part = spark.sparkContext.broadcast(pickle.dumps(sorted(((r.i, r.t) for r in group.toLocalIterator()), key=str)))
        last = k == passes - 1
        frame = frame.mapInArrow(lean(_scanner(part, width, k == 0, last)), ", ".join(["_n long", f"_s {span}", "_i array<bigint>", *([f"_o {span}"] if last else fields[:1]), *fields[1:]]))
        frame = frame if last else scratch.table(frame, str(k))
    n_hit = F.aggregate("_s", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    return frame.select(*kept, F.col("_n").alias("n_words"), n_hit.alias("n_hit"), F.size("_i").cast("long").alias("n_items"), F.col("_i").alias("items"), F.col("_s").alias("spans"), F.col("_o").alias("offsets"))


def contaminated(n_hit="n_hit", n_words="n_words"):
    """At least one word in twenty of the document lies inside a window."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
