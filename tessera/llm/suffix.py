"""Suffix-array deduplication: bytes covered by a long string that an earlier document also holds.

The unit is a *window*: ``length`` bytes at one position.  A window is repeated if a document with
a smaller id holds the same bytes anywhere.  Three steps find all of them exactly:

1. Content-defined chunks.  A chunk's windows all repeat if the chunk with the ``length - 1`` bytes
   after it occurs in an earlier document.  Digests choose the candidates; their bytes decide.
2. Anchors.  Each other window selects its smallest hashed ``gram``-byte string, so equal windows
   select equal anchors, whatever stands around them.  Only windows whose anchor occurs in a second
   document can repeat; sorting anchors by hash leaves few.
3. A sparse suffix array.  Candidate windows meet by anchor.  Their suffixes are merge-sorted, each
   comparison finding the common extension by binary search over prefix polynomial hashes (so its
   cost is logarithmic in the length); equal hashes are verified on the bytes.  Neighbours that
   share ``length`` bytes form a class, whose smallest document keeps its window.

Of what is the same, byte for byte, in a block of rows only the smallest document's goes on (the
others repeat it), so copies are settled where they lie.  Anchors that many rows still share are
dealt out window by window, so no task gathers one; their settled windows go on as whole spans, so
the rows stay in proportion to the input however many anchors grow hot with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lean

#: Length of a repeated string, length of an anchor, mean length of a chunk, all in bytes.
LENGTH, GRAM, CHUNK = 50, 20, 128
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Documents with a null id come after all others.
LAST = (1 << 63) - 1
#: Bytes of contexts that are sorted at once.
SORT_BYTES = 1 << 19
#: Texts are hashed in slices of so many bytes.
SLICE = 1 << 16
#: Anchors are counted in so many buckets; one with more rows than HOT_ROWS and four times the mean is dealt by window.
BUCKETS, HOT_ROWS = 1 << 20, 2048
#: On many partitions that bound is HOT_EACH rows for each, HOT_MOST at most, so that a hot window's copies still meet in a block.
HOT_EACH, HOT_MOST = 16, 1 << 14
#: Anchors are packed, and bytes of contexts compared, so many at a time.
ANCHORS, BLOCK_BYTES = 1 << 19, 1 << 22
#: A part of the packed anchors holds those of so many windows.
PART_WINDOWS = 1 << 23


def _powers(n: int, base: int) -> np.ndarray:
    if n <= 1 << 15:
        return _small_powers(base)[:n]
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(2)
def _small_powers(base: int) -> np.ndarray:
    """The first 2^15 powers, 256 kB."""
    out = np.full(1 << 15, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``out[i]`` = sum of (byte j + 1) * BASE^j for j < i, modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), int(BASE)), out=out[1:])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes at each position, from prefix hashes; the same wherever the bytes stand."""
    if len(data) < n:
        return np.empty(0, np.uint64)
    p = prefix_hashes(data)
    return _mixed((p[n:] - p[:-n]) * _powers(len(data) - n + 1, int(INVERSE)))


def chunk_bounds(data: np.ndarray, length: int = LENGTH, mean: int = CHUNK) -> np.ndarray:
    """Edges of chunks of window starts: a chunk begins where the 16 bytes there hash low."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = [at + np.flatnonzero(gram_hashes(data[at : min(n, at + SLICE) + 15], 16) < np.uint64((1 << 64) // mean)) for at in range(0, n, SLICE)]
    low = np.concatenate(low)
    return np.concatenate(([0], low[(low > 0) & (low < n)], [n]))


def smallest_in(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the position of the smallest one, the leftmost if several.

    Hashes are compared without the low bits, in which their positions are kept; how many these are
    depends on ``width`` only, so equal runs select alike wherever they stand.
    """
    bits = np.uint64((2 * SLICE + width).bit_length())
    if len(h) >> int(bits):
        raise ValueError("more hashes than a slice has")
    low, span = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64), 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[step:], low[:-step])
        span += step
    return (low & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)


def anchors(data: np.ndarray, skip: list[tuple[int, int]], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last+1 window start of each run of windows that select one anchor; windows in the spans ``skip`` are left out.

    A run ends at the edge of a slice, too.
    """
    found = [[np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    skip, k = sorted(skip), 0
    for begin in range(0, len(data) - length + 1, SLICE):
        part = data[begin : begin + SLICE + length - 1]
        h = gram_hashes(part, gram)
        at = smallest_in(h, length - gram + 1)
        while k < len(skip) and skip[k][0] < begin + len(at):
            at[max(0, skip[k][0] - begin) : max(0, skip[k][1] - begin)] = -1
            if skip[k][1] > begin + len(at):
                break
            k += 1
        edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
        first, stop = edge[:-1], edge[1:]
        keep = at[first] >= 0
        first, stop = first[keep], stop[keep]
        for x, y in zip(found, (h[at[first]], first + begin, stop + begin), strict=True):
            x.append(y)
    return tuple(map(np.concatenate, found))


class Extensions:
    """Common extensions of suffixes of ``data`` by prefix hashes and binary search."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.prefix = data, length, prefix_hashes(data)
        self.powers = _powers(len(data), int(BASE))
        self.head = np.zeros(len(data), np.uint64)  # a suffix's first bytes, the first one highest
        for k in range(min(8, length)):
            self.head <<= np.uint64(8)
            self.head[: max(0, len(data) - k)] |= data[k:]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes, at most ``length``, that the suffixes at ``a`` and ``b`` share."""
        a, b = np.minimum(a, b), np.maximum(a, b)
        out = np.full(len(a), self.length)
        shift, pa_, pb = self.powers[b - a], self.prefix[a], self.prefix[b]
        part = np.flatnonzero((self.prefix[a + self.length] - pa_) * shift != self.prefix[b + self.length] - pb)
        if not len(part):
            return out
        a, b, shift, pa_, pb = a[part], b[part], shift[part], pa_[part], pb[part]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length - 1)
        for _ in range(self.length.bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - pa_) * shift == self.prefix[b + mid] - pb
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(low, mid - 1))
        out[part] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix at ``a`` comes before that at ``b``; equal ones by position."""
        x, y = self.head[a], self.head[b]
        out, tie = x < y, np.flatnonzero(x == y)
        a, b = a[tie], b[tie]
        n = self.common(a, b)
        at = np.minimum(n, self.length - 1)
        out[tie] = np.where(n >= self.length, a < b, self.data[a + at] < self.data[b + at])
        return out


def suffix_sort(ext: Extensions, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of ``starts`` by (group, suffix), by a bottom-up mergesort over all groups at once.

    ``group`` is ascending.  At each level every element finds its rank in the run it merges with by
    binary search, all of them together, each step one comparison of ``Extensions``.
    """
    order = np.arange(len(starts))
    first = np.searchsorted(group, group, "left")
    stop = np.searchsorted(group, group, "right")
    place = np.arange(len(starts))
    width, most = 1, int((stop - first).max(initial=0))
    while width < most:
        run = (place - first) // width
        mine = first + run * width
        other = np.where(run % 2 == 0, mine + width, mine - width)
        left, right = np.minimum(other, stop), np.minimum(other + width, stop)
        base = left.copy()
        suffix = starts[order]
        open_ = np.flatnonzero(left < right)
        while len(open_):
            mid = (left[open_] + right[open_]) >> 1
            before = ext.less(suffix[mid], suffix[open_])
            left[open_] = np.where(before, mid + 1, left[open_])
            right[open_] = np.where(before, right[open_], mid)
            open_ = open_[left[open_] < right[open_]]
        to = np.where(run % 2 == 0, place, place - width) + (left - base)
        merged = np.empty_like(order)
        merged[to] = order
        order = merged
        width *= 2
    return order


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` and ``b`` are the same."""
    size = np.broadcast_to(size, len(a))
    out, span = np.empty(len(a), bool), np.arange(int(size.max(initial=0)))
    step = max(1, (1 << 20) // max(1, len(span)))
    for i in range(0, len(a), step):
        x, y, over = a[i : i + step, None] + span, b[i : i + step, None] + span, span >= size[i : i + step, None]
        same = data.take(x, mode="clip") == data.take(y, mode="clip")
        out[i : i + step] = (same | over).all(axis=1)
    return out


def run_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hash of the ``size`` bytes at each of ``at``; the same wherever the bytes stand."""
    p = prefix_hashes(data)
    return _mixed((p[at + size] - p[at]) * _powers(len(data) + 1, int(INVERSE))[at])


def leads(data: np.ndarray, at: np.ndarray, size: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each run the first one of the smallest ``doc`` with the same bytes.

    ``h`` chooses the candidates, the bytes decide: where they differ a run stands for itself.
    """
    by = np.lexsort((doc, size, h))
    new = np.concatenate(([True], (h[by][1:] != h[by][:-1]) | (size[by][1:] != size[by][:-1])))[: len(by)]
    lead = np.empty(len(by), np.int64)
    lead[by] = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    check = np.flatnonzero(lead != np.arange(len(by)))
    wrong = check[~_equal(data, at[check], at[lead[check]], size[check])]
    lead[wrong] = wrong
    return lead


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin[i]``, ``begin[i]`` + 1, ... (``size[i]`` numbers) for each i in turn."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows at ``starts`` equal, within their group, a window of a smaller ``doc``.

    The windows must lie in ``data``, and ``group`` is ascending.  Those whose hash no second
    document of their group has are left out; the rest are suffix-sorted, and neighbours that share
    ``length`` bytes, verified on the bytes, are one class.
    """
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    ext = Extensions(data, length)
    h = (ext.prefix[starts + length] - ext.prefix[starts]) * _powers(len(data), int(INVERSE))[starts]
    h += group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    by = np.argsort(h)
    first = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1])))
    several = np.maximum.reduceat(doc[by], first) > np.minimum.reduceat(doc[by], first)
    some = np.zeros(len(starts), bool)
    some[by] = np.repeat(several, np.diff(np.append(first, len(by))))
    some = np.flatnonzero(some)
    if not len(some):
        return out
    order = some[suffix_sort(ext, starts[some], group[some])]
    a, b = order[:-1], order[1:]
    joined = group[a] == group[b]
    joined[joined] = ext.common(starts[a[joined]], starts[b[joined]]) >= length
    check = np.flatnonzero(joined)
    joined[check] = _equal(data, starts[a[check]], starts[b[check]], length)
    edge = np.concatenate(([0], np.flatnonzero(~joined) + 1))
    out[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], edge), np.diff(np.append(edge, len(order))))
    return out


def merge_spans(spans: np.ndarray, extra: int = 0) -> np.ndarray:
    """Rows (from, to) with ``extra`` added to each end, sorted and merged where they touch."""
    if not len(spans):
        return np.empty((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    stop = np.maximum.accumulate(spans[:, 1] + extra)
    new = np.concatenate(([True], spans[1:, 0] > stop[:-1]))
    return np.stack([spans[new, 0], stop[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def _bytes(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint8) if cell.is_valid and len(cell.as_buffer()) else np.empty(0, np.uint8)


def _flat(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where in them each cell begins; the last number is where they end."""
    wide = cells.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = wide.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8), at


def _cells(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The ``size`` bytes at each of ``at`` as a binary column."""
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[_spread(at, size)])])


def _runs(cell) -> np.ndarray:
    """A packed int32 pair list as rows (from, to)."""
    return np.frombuffer(cell.as_buffer(), np.int32).reshape(-1, 2).astype(np.int64) if cell.is_valid else np.empty((0, 2), np.int64)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _chunks(length: int, digest=xxhash.xxh3_128_digest):
    """Rows (doc, rid, text) to (h1, h2, doc, rid, from, to), a row for each chunk.

    Chunks that equal, byte for byte, one of a smaller document of the batch are known to repeat:
    they have no digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, rids, spans, raws = [], [], [], [], []
            for doc, rid, cell in zip(batch["doc"].to_pylist(), batch["rid"].to_pylist(), batch["text"], strict=True):
                data = _bytes(cell)
                edge = chunk_bounds(data, length)
                if not len(edge):
                    continue
                raw = memoryview(data)
                digests += [digest(raw[a : b + length - 1]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                docs.append(np.full(len(edge) - 1, doc))
                rids.append(np.full(len(edge) - 1, rid))
                raws += [raw] * (len(edge) - 1)
                spans.append(np.stack([edge[:-1], edge[1:]], axis=1))
            if not digests:
                continue
            h, s, doc = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), np.concatenate(spans), np.concatenate(docs)
            by = np.lexsort((doc, h[:, 1], h[:, 0]))
            new = np.concatenate(([True], (h[by][1:] != h[by][:-1]).any(axis=1)))
            lead = np.empty(len(by), np.int64)
            lead[by] = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
            known = np.zeros(len(by), bool)
            for i in np.flatnonzero(doc > doc[lead]).tolist():
                (a, b), (c, d), j = s[i].tolist(), s[lead[i]].tolist(), int(lead[i])
                known[i] = b - a == d - c and raws[i][a : b + length - 1] == raws[j][c : d + length - 1]
            s = s.astype(np.int32)
            yield _batch(["h1", "h2", "doc", "rid", "from", "to"], pa.array(h[:, 0], mask=known), pa.array(h[:, 1], mask=known), doc, np.concatenate(rids), s[:, 0].copy(), s[:, 1].copy())

    return run


def _chunk_bytes(length: int):
    """Rows (doc, rid, text, same) to (h1, h2, doc, rid, from, to, bytes): the bytes of chunks whose digests meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, rid, cell, same in zip(batch["doc"].to_pylist(), batch["rid"].to_pylist(), batch["text"], batch["same"], strict=True):
                raw = memoryview(_bytes(cell))
                rows += [(x["h1"], x["h2"], doc, rid, x["from"], x["to"], bytes(raw[x["from"] : x["to"] + length - 1])) for x in same.as_py()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield _batch(["h1", "h2", "doc", "rid", "from", "to", "bytes"], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h1, h2, doc) those whose bytes a smaller document of the same digest has."""
    digest, least = None, {}
    for batch in batches:
        out = []
        for h1, h2, doc, rid, first, stop, raw in zip(*(batch[c].to_pylist() for c in ("h1", "h2", "doc", "rid", "from", "to", "bytes")), strict=True):
            if (h1, h2) != digest:
                digest, least = (h1, h2), {}
            if least.setdefault(raw, doc) < doc:
                out.append((rid, first, stop))
        columns = zip(*out, strict=True) if out else [[]] * 3
        yield _batch(["rid", "from", "to"], *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)])


def _packed(df: DataFrame, name: str) -> DataFrame:
    """Rows (rid, from, to) as (rid, name): merged pairs, packed; their number is bounded by one document's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch["s"]:
                flat = cell.values
                pairs = np.stack([flat.field("from").to_numpy(), flat.field("to").to_numpy()], axis=1)
                out.append(merge_spans(pairs.astype(np.int64)).astype(np.int32).tobytes())
            yield _batch(["rid", name], batch["rid"], pa.array(out, pa.binary()))

    return df.groupBy("rid").agg(F.collect_list(F.struct("from", "to")).alias("s")).mapInArrow(lean(run), f"rid long, {name} binary")


def _bits(length: int, gram: int) -> int:
    """Bits for the number of windows of a run: those that one anchor lies in, at most."""
    return (length - gram + 1).bit_length()


def _anchors(length: int, gram: int, parts: int):
    """Rows (rid, text, dups) to (part, packed): anchor runs (h, rid, run), ``run`` its first window and their number, packed.

    A row holds the runs of a block of texts whose anchors fall into one of ``parts``.  Runs whose
    anchor another row of the block holds are known to be shared: ``run`` is inverted, and they go to
    any part.  Of each such anchor only two rows' runs go on under the anchor's own part, so an anchor
    that a third of the documents share isn't gathered in one task.
    """
    bits = _bits(length, gram)

    def packed(block: list[list[np.ndarray]]) -> pa.RecordBatch:
        h, rid, run = (np.concatenate(x) for x in zip(*block, strict=True))
        by = np.argsort(h, kind="stable")  # rows of one anchor keep their order, so equal rids are neighbours
        h, rid, run = h[by], rid[by], run[by]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h)))
        nth = np.cumsum(new | np.concatenate(([True], rid[1:] != rid[:-1])))
        nth -= np.repeat(nth[start] - 1, size)  # which row of its anchor, from 1
        known = np.repeat(nth[start + size - 1] > 1, size)
        at = np.flatnonzero(known)  # the first run of each of the first two rows isn't
        known[at[(nth[at] <= 2) & ((nth[at] != nth[at - 1]) | new[at])]] = False
        part = (np.where(known, _mixed((rid * 1_000_003 + run).view(np.uint64)), h.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        run = np.where(known, ~run, run)
        by = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], part[by][1:] != part[by][:-1])))
        rows = np.stack([h[by], rid[by], run[by]], axis=1)
        raw = [rows[a:b].T.tobytes() for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(by)], strict=True)]
        return _batch(["part", "packed"], part[by][edge], pa.array(raw, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            for rid, cell, dup in zip(batch["rid"].to_pylist(), batch["text"], batch["dups"], strict=True):
                data = _bytes(cell)
                if len(data) < length:
                    continue
                h, first, stop = anchors(data, _runs(dup).tolist(), length, gram)
                if not len(h):
                    continue
                block.append([h.view(np.int64), np.full(len(h), rid), first << bits | stop - first])
                held += len(h)
                if held >= ANCHORS:
                    yield packed(block)
                    block, held = [], 0
        if block:
            yield packed(block)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by part the runs whose anchor two rows hold."""

    def of(block: list[np.ndarray]) -> pa.RecordBatch:
        h, rid, run = np.concatenate(block, axis=1)
        known = run < 0
        own = np.flatnonzero(~known)
        own = own[np.argsort(h[own])]
        start = np.flatnonzero(np.concatenate(([True], h[own][1:] != h[own][:-1]))[: len(own)])
        if len(own):
            both = np.minimum.reduceat(rid[own], start) != np.maximum.reduceat(rid[own], start)
            known[own] = np.repeat(both, np.diff(np.append(start, len(own))))
        return _batch(["rid", "run", "h"], rid[known], np.where(run < 0, ~run, run)[known], h[known])

    part, block = None, []
    for batch in batches:
        for p, cell in zip(batch["part"].to_pylist(), batch["packed"], strict=True):
            if p != part and block:
                yield of(block)
                block = []
            part = p
            block.append(np.frombuffer(cell.as_buffer(), np.int64).reshape(3, -1))
    if block:
        yield of(block)


def _contexts(length: int, gram: int, hot):
    """Rows (doc, rid, text, wanted) to (h, doc, rid, from, to, bytes): the bytes of each wanted run of windows.

    Runs that equal, byte for byte, one of a smaller document of the block are known to repeat:
    they have no bytes and any ``h``, and those that touch are one row.  A run whose anchor is in the
    buckets ``hot`` (a broadcast) is a row for each of its other windows, and ``h`` is of the window.
    """
    bits = _bits(length, gram)
    names = ["h", "doc", "rid", "from", "to", "bytes"]
    piece = max(1, (1 << 20) // length)  # runs at once, so that what is copied is bounded

    def block_of(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        data = np.concatenate([x[0] for x in held])
        base = np.cumsum([0, *(len(x[0]) for x in held)])
        at = np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
        key, h, doc, rid, first, n = (np.concatenate([x[k] for x in held]) for k in range(2, 8))
        lead = leads(data, at, n + length - 1, h, doc)
        known = doc > doc[lead]
        i = np.flatnonzero(known)
        i = i[np.lexsort((first[i], rid[i]))]
        if len(i):
            r, a, b = rid[i], first[i], first[i] + n[i]  # runs of a row don't overlap
            new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (a[1:] != b[:-1]))))
            stop = b[np.append(new[1:] - 1, len(i) - 1)]
            any_ = (_mixed((r[new] * 1_000_003 + a[new]).view(np.uint64)) >> np.uint64(1)).astype(np.int64)
            yield _batch(names, any_, doc[i][new], r[new], a[new].astype(np.int32), stop.astype(np.int32), pa.nulls(len(new), pa.binary()))
        rest = np.flatnonzero(~known)
        for k in range(0, len(rest), piece):
            i = rest[k : k + piece]
            yield _batch(names, key[i], doc[i], rid[i], first[i].astype(np.int32), (first[i] + n[i]).astype(np.int32), _cells(data, at[i], n[i] + length - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_hot = np.zeros(BUCKETS, bool)
        is_hot[hot.value] = True
        held: list[tuple] = []
        total = 0
        for batch in batches:
            texts, begin = _flat(batch["text"])
            want, doc, rid = batch["wanted"], batch["doc"].to_numpy(), batch["rid"].to_numpy()
            row = np.repeat(np.arange(len(want)), want.value_lengths().to_numpy())
            runs, keys = (want.flatten().field(k).to_numpy() for k in ("run", "h"))
            for x in range(0, len(row), piece):
                r, key, run_ = row[x : x + piece], keys[x : x + piece], runs[x : x + piece]
                first, n = run_ >> bits, run_ & (1 << bits) - 1
                size = n + length - 1
                data = texts[_spread(begin[r] + first, size)]
                at = np.cumsum(size) - size
                apart = is_hot[key & BUCKETS - 1]
                each = np.where(apart, n, 1)
                i = np.repeat(np.arange(len(r)), each)
                shift = _spread(np.zeros(len(each), np.int64), each)
                at, n, first = at[i] + shift, np.where(apart, 1, n)[i], first[i] + shift
                h = run_hashes(data, at, n + length - 1)
                key = np.where(apart[i], (h >> np.uint64(1)).view(np.int64), key[i])
                held.append((data, at, key, h, doc[r][i], rid[r][i], first, n))
                total += int((n + length - 1).sum())
                if total >= BLOCK_BYTES:
                    yield from block_of(held)
                    held, total = [], 0
        if held:
            yield from block_of(held)

    return run


def _sorted_hits(length: int):
    """Rows (h, doc, rid, from, to, bytes) sorted by (h, doc) to the repeated runs (rid, from, to); rows without bytes are known to be such.

    Whole anchors are sorted together, about SORT_BYTES at a time.  A run that equals an earlier one
    byte for byte repeats as a whole, if its document is larger, or shares the fate of it; the others
    are suffix-sorted.
    """

    def of(rid: np.ndarray, first: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
        return _batch(["rid", "from", "to"], rid, first.astype(np.int32), stop.astype(np.int32))

    def hits(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, doc, rid, first, stop = (np.concatenate([x[c].to_numpy() for x in held]) for c in ("h", "doc", "rid", "from", "to"))
        parts = [_flat(x["bytes"]) for x in held]
        data = np.concatenate([*(x[at[0] : at[-1]] for x, at in parts), np.zeros(length, np.uint8)])
        first, stop = first.astype(np.int64), stop.astype(np.int64)
        size = stop - first + length - 1
        at = np.cumsum(size) - size
        lead = leads(data, at, size, run_hashes(data, at, size), doc)
        whole = doc > doc[lead]
        if whole.any():
            yield of(rid[whole], first[whole], stop[whole])
        own = np.flatnonzero(lead == np.arange(len(lead)))
        edge = np.flatnonzero(np.concatenate(([True], h[own][1:] != h[own][:-1])))
        group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(own))))
        several = np.bincount(group)[group] > 1
        own, group = own[several], group[several]
        if not len(own):
            return
        per = stop[own] - first[own]
        row = np.repeat(np.arange(len(own)), per)
        shift = _spread(np.zeros(len(own), np.int64), per)
        i = np.flatnonzero(repeated(data, at[own][row] + shift, group[row], doc[own][row], length))
        if not len(i):
            return
        new = np.concatenate(([True], (row[i][1:] != row[i][:-1]) | (shift[i][1:] != shift[i][:-1] + 1)))
        a, b = i[new], i[np.append(np.flatnonzero(new)[1:] - 1, len(i) - 1)]
        k, x, y = own[row[a]], shift[a], shift[b] + 1
        yield of(rid[k], first[k] + x, first[k] + y)
        alike = np.flatnonzero((lead != np.arange(len(lead))) & ~whole)  # k ascends, so a lead's spans are neighbours
        low, high = np.searchsorted(k, lead[alike], "left"), np.searchsorted(k, lead[alike], "right")
        to, j = np.repeat(alike, high - low), _spread(low, high - low)
        if len(to):
            yield of(rid[to], first[to] + x[j], first[to] + y[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total, last = 0, None
        for batch in batches:
            known = batch.filter(batch["bytes"].is_null())
            if known.num_rows:
                yield _batch(["rid", "from", "to"], known["rid"], known["from"], known["to"])
            batch = batch.filter(batch["bytes"].is_valid())
            if not batch.num_rows:
                continue
            h = batch["h"].to_numpy()
            size = np.cumsum(batch["to"].to_numpy().astype(np.int64) - batch["from"].to_numpy() + length - 1)
            begin = 0
            edges = [] if total + int(size[-1]) <= SORT_BYTES else np.flatnonzero(np.concatenate(([h[0] != last], h[1:] != h[:-1]))).tolist()
            for e in edges:
                if total + int(size[e - 1] if e else 0) - int(size[begin - 1] if begin else 0) > SORT_BYTES:
                    held.append(batch.slice(begin, e - begin))
                    yield from hits(held)
                    held, total, begin = [], 0, e
            held.append(batch.slice(begin))
            total += int(size[-1]) - int(size[begin - 1] if begin else 0)
            last = h[-1]
        if held:
            yield from hits(held)

    return run


def _removed(length: int, as_text: bool):
    """Rows (doc columns, text, dups, hits) to the text that is left, and the removed byte spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, removed, sizes = [], [], []
            for cell, *runs in zip(batch["text"], batch["dups"], batch["hits"], strict=True):
                data = _bytes(cell)
                spans = merge_spans(np.concatenate([_runs(r) for r in runs]), length - 1)
                mask = np.ones(len(data), bool)
                for a, b in spans.tolist():
                    mask[a:b] = False
                left.append(data[mask].tobytes().decode("utf-8", "ignore") if as_text else data[mask].tobytes())
                removed.append([{"from": a, "to": b} for a, b in spans.tolist()])
                sizes.append(len(data))
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield _batch(["rid", "n_bytes", "kept", "spans"], batch["rid"], pa.array(sizes, pa.int64()), pa.array(left, pa.string() if as_text else pa.binary()), pa.array(removed, span))

    return run


def dedup_substrings(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, length: int = LENGTH, gram: int = GRAM, hot_rows: int | None = None, digest=xxhash.xxh3_128_digest, as_text: bool = False) -> DataFrame:
    """Remove from each text the bytes that ``length``-byte strings of earlier documents cover.

    Texts are UTF-8 bytes; matches don't cross documents; strings are judged on the input.  Returns
    the columns in ``keep`` (the id by default), then ``n_bytes long``, ``kept binary`` (the
    remaining bytes, which may not be whole characters; with ``as_text`` a string, in which of a
    character that is only in part removed nothing stays) and ``spans`` (removed runs [from, to)).

    A null text is empty.  Texts shorter than ``length`` keep everything.  Very long texts are hashed
    in slices.  Rows with the same id are one document: they don't remove from each other, so repeated
    rows lose the same bytes.  Rows with a null id come after all others and are one document.  Of
    documents that share a string the smallest id's keeps it; there are no other ties.  Columns that
    aren't kept are ignored, whatever their names; kept ones come first, so a kept column called
    ``n_bytes``, ``kept`` or ``spans`` must be renamed by the caller.  An empty table gives no rows.
    (Where an id is 2^63 - 1, ids are lowered by one to tell it from null; -2^63 then counts as -2^63 + 1.)

    The texts are written once, bucketed by row, so that each later step moves only digests, anchors
    or spans to them.
    """
    if not 0 < gram <= length:
        raise ValueError("an anchor lies inside a window")
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "suffix")
    keep = [doc_id] if keep is None else keep
    number = F.col(doc_id).cast("long")
    if documents.where(number == LAST).limit(1).count():
        number = F.when(number >= 1 - LAST, number - 1).otherwise(number)
    base = documents.select(F.coalesce(number, F.lit(LAST)).alias("doc"), F.col(text).cast("binary").alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    base = scratch.bucketed(base.withColumn("rid", F.monotonically_increasing_id()), "texts", "rid")
    texts = base.select("doc", "rid", "text")

    chunks = scratch.table(texts.mapInArrow(lean(_chunks(length, digest)), "h1 long, h2 long, doc long, rid long, from int, to int"), "chunks")
    met = chunks.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("h1", "h2")
    same = chunks.join(met, ["h1", "h2"]).groupBy("rid").agg(F.collect_list(F.struct("h1", "h2", "from", "to")).alias("same"))
    same = texts.join(same.hint("shuffle_hash"), "rid").select("doc", "rid", "text", "same").mapInArrow(lean(_chunk_bytes(length)), "h1 long, h2 long, doc long, rid long, from int, to int, bytes binary")
    same = same.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc").mapInArrow(lean(_verified), "rid long, from int, to int")
    dups = scratch.table(_packed(chunks.where("h1 is null").select("rid", "from", "to").unionByName(same), "dups"), "dups")
    windows = chunks.agg(F.sum(F.col("to").cast("long") - F.col("from"))).first()[0] or 0
    scratch.drop("chunks")

    with_dups = texts.join(dups.hint("shuffle_hash"), "rid", "left")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = n * (windows // (n * PART_WINDOWS) + 1)
    runs = with_dups.select("rid", "text", "dups").mapInArrow(lean(_anchors(length, gram, parts)), "part long, packed binary")
    shared = runs.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(lean(_shared), "rid long, run long, h long")
    wanted = scratch.table(shared.groupBy("rid").agg(F.collect_list(F.struct("run", "h")).alias("wanted")), "wanted")

    contexts = texts.join(wanted.hint("shuffle_hash"), "rid").select("doc", "rid", "text", "wanted").mapInArrow(lean(_contexts(length, gram, _hot(spark, wanted, hot_rows))), "h long, doc long, rid long, from int, to int, bytes binary")
    found = contexts.repartition("h").sortWithinPartitions("h", "doc").mapInArrow(lean(_sorted_hits(length)), "rid long, from int, to int")
    hits = scratch.table(_packed(found, "hits"), "hits")
    scratch.drop("wanted")

    decided = dups.join(hits, "rid", "full")
    full = base.join(decided.hint("shuffle_hash"), "rid", "left")
    done = full.select("rid", "text", "dups", "hits", *[f"k{i}" for i in range(len(keep))])
    return _finish(done, keep, length, as_text)


def _hot(spark: SparkSession, wanted: DataFrame, least: int | None = None):
    """The buckets of anchors with more rows than ``least`` and than four times the mean: at most a quarter of BUCKETS numbers."""
    total = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    counts = wanted.select(F.explode("wanted.h").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count()
    if least is None:
        least = max(HOT_ROWS, min(HOT_MOST, HOT_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = counts.where(F.col("count") > max(least, 4 * total // BUCKETS)).select("b").collect()
    return spark.sparkContext.broadcast(np.array([r.b for r in hot], np.int64))


def _finish(done: DataFrame, keep: list[str], length: int, as_text: bool) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in done.schema}
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = _removed(length, as_text)
        for batch in batches:
            for out in inner(iter([batch])):
                yield _batch(["n_bytes", "kept", "spans", *kept], out["n_bytes"], out["kept"], out["spans"], *[batch[k] for k in kept])

    made = done.mapInArrow(lean(run), ", ".join([f"n_bytes long, kept {'string' if as_text else 'binary'}, spans array<struct<`from`:bigint,`to`:bigint>>", *[f"{k} {types[k]}" for k in kept]]))
    return made.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "n_bytes", "kept", "spans")
