"""Splitting documents into chunks.

Fixed windows and overlaps are plain expressions; splitters whose cuts depend
on what came before run as small kernels over Arrow batches, a document at a
time. All kernels cover the whole text and always advance.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .parallel import SLICE

CHUNKS = "doc_id long, chunk_index int, start_char int, end_char int, content string, token_count int"


def fixed_windows(docs: DataFrame, size: int = 1000, overlap: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_index, start_char, end_char, content: windows of `size` characters, `size - overlap` apart; the last one reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.char_length(text) - overlap) / step)).cast("int")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    rows = rows.withColumn("start_char", start).withColumn("content", F.substring("_text", start + 1, F.lit(size)))
    return rows.select("doc_id", "chunk_index", "start_char", (F.col("start_char") + F.char_length("content")).alias("end_char"), "content")


def with_overlap(chunks: DataFrame, words: int = 50, doc_id: str = "doc_id") -> DataFrame:
    """Put the last `words` words of the chunk before in front of each chunk, if that has more."""
    before = F.lag("content").over(Window.partitionBy(doc_id).orderBy("chunk_index"))
    parts = F.filter(F.split(F.col("_before"), r"\s+"), lambda w: w != "")
    tail = F.when(F.size(parts) > words, F.array_join(F.slice(parts, -words, words), " "))
    out = chunks.withColumn("_before", before)
    return out.withColumn("content", F.when(tail.isNotNull(), F.concat(tail, F.lit(" "), F.col("content"))).otherwise(F.col("content"))).drop("_before")


# --- kernels: text -> [(start, end)] ---------------------------------------------------


def words_in(text: str) -> int:
    return len(text.split())


def _packed(text: str, cuts: list[int], size: Callable[[str], int], most: int) -> Iterator[tuple[int, int]]:
    """Greedy packing of the parts between cuts, each piece of at most `most` unless a part alone is larger."""
    start = 0
    held = 0
    edges = [*cuts, len(text)]
    at = 0
    for end in edges:
        if end <= at:
            continue
        n = size(text[at:end])
        if held and held + n > most:
            yield start, at
            start, held = at, 0
        held += n
        at = end
    if at > start:
        yield start, at


def sentence_spans(text: str, most: int = 200, size: Callable[[str], int] = words_in) -> list[tuple[int, int]]:
    """Sentences packed up to `most` words, or tokens if `size` counts those."""
    return list(_packed(text, [m.end() for m in re.finditer(r"[.!?]+[\s\n]+", text)], size, most))


def recursive_spans(text: str, most: int = 200, at: int = 0, size: Callable[[str], int] = words_in) -> list[tuple[int, int]]:
    """Split at the coarsest break that helps (lines, sentences, clauses, words, halves) and pack up to `most` words, or tokens if `size` counts those."""
    if size(text) <= most and len(text) <= 16 * most:
        return [(at, at + len(text))] if text else []
    for pattern in (r"\n+", r"[.!?]+\s+", r"[,;:]\s+", r"\s+"):
        cuts = [m.end() for m in re.finditer(pattern, text) if m.end() < len(text)]
        if cuts:
            out = []
            for a, b in _packed(text, cuts, size, most):
                out += [(at + a, at + b)] if (a, b) == (0, len(text)) else recursive_spans(text[a:b], most, at + a, size)
            if len(out) > 1:
                return out
    middle = len(text) // 2
    return recursive_spans(text[:middle], most, at, size) + recursive_spans(text[middle:], most, at + middle, size)


def paragraph_spans(text: str, most: int = 1000) -> list[tuple[int, int]]:
    """Paragraphs (between blank lines, or lines if there is none) packed up to `most` characters."""
    pattern = r"\n\s*\n" if re.search(r"\n\s*\n", text) else r"\n"
    return list(_packed(text, [m.end() for m in re.finditer(pattern, text)], len, most))


def structural_spans(text: str, most: int = 1000, window: int = 200) -> list[tuple[int, int]]:
    """Headings, lists, rules, code fences, tables and paragraphs start parts; parts too long are cut at sentence ends."""
    marks = [m.start() for m in re.finditer(r"(?m)^(?:#{1,6}\s|[-*+]\s|\d+\.\s|```|\||---+\s*$)|\n\s*\n", text)]
    out = []
    for a, b in _packed(text, [m for m in marks if m], len, most):
        out += [(a, b)] if b - a <= most else [(a + x, a + y) for x, y in sliding_spans(text[a:b], most, 0, window)]
    return out


def sliding_spans(text: str, most: int = 1000, overlap: int = 100, window: int = 200) -> list[tuple[int, int]]:
    """Windows that end at a sentence end within their last `window` characters, if there is one; each starts after the one before."""
    out, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            found = max(text.rfind(c, max(start + 1, end - window), end) for c in ".!?\n")
            end = found + 1 if found > start else end
        out.append((start, end))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def sliding_tail_spans(text: str, most: int = 1000, overlap: int = 100, window: int = 200) -> list[tuple[int, int]]:
    """Like `sliding_spans`, with what the last two windows would share as a chunk of its own at the end of a text that was cut."""
    out = sliding_spans(text, most, overlap, window)
    start = max(len(text) - overlap, out[-1][0] + 1) if out else 0
    return [*out, (start, len(text))] if len(out) > 1 and start < len(text) else out


def headed_spans(text: str, most: int = 512) -> list[tuple[int, int, str]]:
    """(start, end, heading path): paragraphs under one heading packed up to `most` words; larger ones are cut as in `recursive_spans`."""
    heads = [(m.start(), len(m.group(1)), m.group(2).strip()) for m in re.finditer(r"(?m)^(#{1,6})\s+(.+)$", text)]
    path: list[tuple[int, str]] = []
    out = []
    for at, (start, end) in enumerate(zip([0, *(h[0] for h in heads)], [*(h[0] for h in heads), len(text)], strict=True)):
        if at:
            _, level, title = heads[at - 1]
            path = [*(p for p in path if p[0] < level), (level, title)]
        part = text[start:end]
        cuts = [m.end() for m in re.finditer(r"\n\s*\n", part)]
        for a, b in _packed(part, cuts, words_in, most):
            for x, y in [(a, b)] if words_in(part[a:b]) <= most else recursive_spans(part[a:b], most, a):
                if part[x:y].strip():
                    out.append((start + x, start + y, " > ".join(p[1] for p in path)))
    return out


KERNELS = {"sliding_tail": sliding_tail_spans, "sentences": sentence_spans, "recursive": recursive_spans, "paragraphs": paragraph_spans, "structural": structural_spans, "sliding": sliding_spans}


def split(docs: DataFrame, kernel: str | Callable[[str], list[tuple[int, int]]], doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The canonical chunk table by one of KERNELS or a function of a text; null and empty texts have no chunk.

    `options` are the kernel's: `most` (at least 1), `overlap` (at least 0 and
    below `most`), `window`, and `size`, a function that counts a text's tokens.
    """
    spans = KERNELS[kernel] if isinstance(kernel, str) else kernel
    if options.get("most", 1) < 1 or not 0 <= options.get("overlap", 0) < options.get("most", 1000):
        raise ValueError("most must be at least 1, overlap at least 0 and below most")
    if unknown := set(options) - set(inspect.signature(spans).parameters):
        raise ValueError(f"the kernel doesn't take {sorted(unknown)}")
    count = options.get("size", words_in)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[i : i + SLICE] for whole in frames for i in range(0, len(whole), SLICE)):
            rows = [(d, i, a, b, t[a:b], count(t[a:b])) for d, t in zip(pdf["doc_id"], pdf["_text"], strict=True) if t for i, (a, b) in enumerate(spans(t, **options))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start_char", "end_char", "content", "token_count"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInPandas(run, CHUNKS)


def hybrid(docs: DataFrame, most: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The canonical chunk table with `heading_path` and `contextual`, the chunk's text below its headings; chunks never cross a heading."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[i : i + SLICE] for whole in frames for i in range(0, len(whole), SLICE)):
            rows = [(d, i, a, b, t[a:b], words_in(t[a:b]), path) for d, t in zip(pdf["doc_id"], pdf["_text"], strict=True) if t for i, (a, b, path) in enumerate(headed_spans(t, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start_char", "end_char", "content", "token_count", "heading_path"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInPandas(run, f"{CHUNKS}, heading_path string")
    return rows.withColumn("contextual", F.when(F.col("heading_path") == "", F.col("content")).otherwise(F.concat("heading_path", F.lit("\n"), "content")))


def parsed(docs: DataFrame, metadata: list[str], kernel: str = "recursive", overlap: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of parsed documents with an overlap of words and some of the document's columns as `metadata`, a JSON text; documents need ids of their own."""
    about = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.to_json(F.struct(*metadata)).alias("metadata"))
    return with_overlap(split(docs, kernel, doc_id, text), overlap).join(about, "doc_id")
