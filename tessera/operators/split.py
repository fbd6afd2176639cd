"""Splitting text: overlapping windows, recursive splitting at separators, and joining hard-wrapped lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions.text import collapse_blanks, newlines, strip

#: Fixed value: CJK signs and their punctuation, by code point.
WIDE = r"\u4e00-\u9fff\u3000-\u303f\uff00-\uffef"
#: Separators from strong to weak, ends of sentences, starts of blocks.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "：", "，", " ", "")
SENTENCE_END = ("。", "！", "？", "；", "：", ".", "!", "?", ";", ":", "”", "』", "」", "）", ")", "】")
BLOCK_START = r"^\s*(?:[#>*\-•·]|\(?\d+(?:[.)、]|\s)|\d+(?:\.\d+)+|[（(]?[一二三四五六七八九十百]+[）)、.]|第[一二三四五六七八九十百\d]+[章节讲篇部分])"
MIN_MERGE = 20
_ENDS = "".join(f"\\{x}" if x in ".?)" else x for x in SENTENCE_END)
_TOKENS = re.compile(r"\w+|[^\w\s]")


def windows(text: str, size: int = 1000, overlap: int = 200) -> Iterator[tuple[int, str]]:
    """(start, chunk) of windows that go back to the last blank past their middle; the tail may repeat."""
    if overlap * 2 > size:
        raise ValueError("the overlap is at most half the size")
    at = 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            blank = text.rfind(" ", at, stop)
            stop = blank if blank - at > size // 2 else stop
        yield at, text[at:stop]
        at = stop - overlap


def recursive(text: str, size: int, overlap: int, length: Callable[[str], int] = len, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """(start, chunk): pieces between the strongest separators that fit, merged up to ``size`` with ``overlap``.

    Separators stay at the head of the piece that follows; chunks are stripped; ``start`` is the
    chunk's offset in the text.  A piece longer than ``size`` without a weaker separator stays whole.
    """

    def pieces(lo: int, hi: int, level: int) -> list[tuple[int, int]]:
        if length(text[lo:hi]) <= size or level == len(separators):
            return [(lo, hi)]
        sep = separators[level]
        if sep == "":
            return [(i, i + 1) for i in range(lo, hi)]
        cuts = [m.start() for m in re.finditer(re.escape(sep), text[lo:hi]) if m.start()]
        if not cuts:
            return pieces(lo, hi, level + 1)
        edge = [lo, *(lo + c for c in cuts), hi]
        return [x for a, b in zip(edge, edge[1:], strict=False) for x in pieces(a, b, level + 1)]

    out: list[tuple[int, str]] = []
    held: list[tuple[int, int]] = []

    def emit() -> None:
        raw = text[held[0][0] : held[-1][1]]
        body = raw.strip()
        if body:
            out.append((held[0][0] + len(raw) - len(raw.lstrip()), body))

    for a, b in pieces(0, len(text), 0):
        if held and length(text[held[0][0] : b]) > size:
            emit()
            while held and (length(text[held[0][0] : held[-1][1]]) > overlap or length(text[held[0][0] : b]) > size):
                held.pop(0)
        held.append((a, b))
    if held:
        emit()
    return out


def token_count(text: str) -> int:
    """The built-in length in tokens: words, and every sign that is neither word nor blank."""
    return len(_TOKENS.findall(text))


def splitter(config: EngineConfig, length: Callable[[str], int] | None = None) -> Callable[[str], list[tuple[int, str]]]:
    """recursive() by the settings: in characters, or in tokens as ``length`` (a model's tokenizer, say) counts them."""
    size_of = length or (token_count if config.chunk_unit == "token" else len)
    return lambda text: recursive(text, config.chunk_size, config.chunk_overlap, size_of)


def join_lines(a: Column, b: Column) -> Column:
    """No blank beside a CJK sign, a trailing hyphen goes, else one blank."""
    wide = a.rlike(f"[{WIDE}]$") | b.rlike(f"^[{WIDE}]") | (a == "") | (b == "")
    return F.when(wide, F.concat(a, b)).when(a.endswith("-"), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).otherwise(F.concat(a, F.lit(" "), b))


def paragraphs(text: Column) -> Column:
    """Lines of hard-wrapped text joined into paragraphs; short lines, block starts and sentence ends stay apart.

    A fold over the lines in the JVM: what is folded so far is one string, whose last line may still grow.
    """
    lines = F.transform(F.split(collapse_blanks(newlines(F.coalesce(text, F.lit("")))), "\n"), strip)

    def step(done: Column, line: Column) -> Column:
        last = F.substring_index(done, "\n", -1)
        short = (F.length(last) < MIN_MERGE) | (F.length(line) < MIN_MERGE)
        apart = (last == "") | (line == "") | short | last.rlike(f"[{_ENDS}]$") | line.rlike(BLOCK_START)
        return F.when(apart, F.concat(done, F.lit("\n"), line)).otherwise(F.concat(F.substring(done, F.lit(1), F.length(done) - F.length(last)), join_lines(last, line)))

    first = F.element_at(lines, 1)
    whole = F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), first, step)
    return strip(F.regexp_replace(whole, r"\n{3,}", "\n\n"))


def split(docs: DataFrame, splitter: Callable[[str], list[tuple[int, str]]], text: str = "page_content", normalise: bool = False) -> DataFrame:
    """A row for each chunk: the other columns, then chunk_no (from 1), total_chunks, start_index and the chunk as ``text``."""
    rest = [c for c in docs.columns if c not in (text, "chunk_no", "total_chunks", "start_index")]
    body = paragraphs(F.col(text)) if normalise else F.col(text)
    frame = docs.select(body.alias("_t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, total, start, body = [], [], [], [], []
            for i, cell in enumerate(batch.column(0)):
                t = cell.as_py() or ""
                found = list(splitter(t))
                for n, (at, chunk) in enumerate(found, 1):
                    row.append(i)
                    no.append(n)
                    total.append(len(found))
                    start.append(at)
                    body.append(chunk)
            kept = [c.take(pa.array(row, pa.int64())) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, pa.int64()) for v in (no, total, start)), pa.array(body, pa.string())], [*batch.schema.names[1:], "n", "t", "s", "b"])

    made = frame.mapInArrow(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in frame.schema[1:]], "n long, t long, s long, b string"]))
    return made.toDF(*rest, "chunk_no", "total_chunks", "start_index", text)


def normalised(docs: DataFrame, text: str = "page_content") -> DataFrame:
    """``docs`` with paragraphs() of the text."""
    return docs.withColumn(text, paragraphs(F.col(text)))
