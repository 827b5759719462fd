"""Splitting oversized texts at natural boundaries, with overlap.

``split_oversized`` takes the last natural boundary that keeps a piece within the limit, as the
test data state it.  ``split_by_content`` is content-defined chunking: landmarks of a rolling
hash over the last tokens, snapped to the nearest natural boundary between a minimum and a
maximum size, so that an edit alters only the pieces next to it.

A token is a maximal run of characters other than space, tab, carriage return and line feed.
Defined results: null, empty and blank texts and texts within the limit give no row; a null id
stays null; repeated rows count once; texts are processed whole, however long.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = re.compile(r"[^ \t\r\n]+")
GAPS = re.compile(r"[ \t\r\n]+")
SENTENCE_END = re.compile(r"[.!?…][)\]\"'”’»]*\Z")


def boundaries(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tokens, token numbers after which a paragraph ends, after which a sentence ends)."""
    tokens = TOKENS.findall(text)
    gaps = GAPS.findall(text.strip(" \t\r\n"))
    paragraphs = np.array([i + 1 for i, gap in enumerate(gaps) if gap != " " and gap.count("\n") >= 2], np.int64)
    sentences = np.array([i + 1 for i, token in enumerate(tokens) if SENTENCE_END.search(token)], np.int64)
    return tokens, paragraphs, sentences


def _last_upto(ends: np.ndarray, low: int, high: int) -> int:
    """The greatest of ends in (low, high], or -1."""
    at = int(np.searchsorted(ends, high, side="right")) - 1
    return int(ends[at]) if at >= 0 and ends[at] > low else -1


def cut_greedy(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Own texts (start, end) in tokens of a text over the limit."""
    tokens, paragraphs, sentences = boundaries(text)
    size, start, pieces = len(tokens), 0, []
    if size <= limit:
        return []
    while start < size:
        room = start + limit - min(overlap, start)
        end = size if size <= room else _last_upto(paragraphs, start, room)
        if end < 0:
            end = _last_upto(sentences, start, room)
        if end < 0:
            end = room
        pieces.append((start, end))
        start = end
    return pieces


def cut_by_content(text: str, limit: int, overlap: int, least: int = 80, window: int = 12, every: int = 64) -> list[tuple[int, int]]:
    """Own texts (start, end): the first landmark past the least size, snapped to a boundary near it."""
    tokens, paragraphs, sentences = boundaries(text)
    size = len(tokens)
    if size <= limit:
        return []
    mask = (1 << 64) - 1
    codes = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in tokens]
    factor, drop, rolling, marks = 0x9E3779B97F4A7C15 | 1, 1, 0, []
    for _ in range(window):
        drop = drop * factor & mask
    for i, code in enumerate(codes):
        rolling = (rolling * factor + code) & mask
        if i >= window:
            rolling = (rolling - codes[i - window] * drop) & mask
        if i + 1 >= window and (rolling >> 40) % every == 0:
            marks.append(i + 1)
    landmark, start, pieces = np.array(marks, np.int64), 0, []
    natural = np.union1d(paragraphs, sentences)
    while start < size:
        room = start + limit - min(overlap, start)
        if size <= room:
            end = size
        else:
            at = int(np.searchsorted(landmark, start + least))
            end = int(landmark[at]) if at < len(landmark) and landmark[at] <= room else room
            near = natural[(natural >= start + least) & (natural <= room)]
            if len(near):
                end = int(near[np.argmin(np.abs(near - end))])
        pieces.append((start, end))
        start = end
    return pieces


def _split(chunks: DataFrame, cut: Callable[[str], list[tuple[int, int]]], limit: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, starts, ends = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                pieces = cut(text)
                rows += [i] * len(pieces)
                number += range(len(pieces))
                starts += [s for s, _ in pieces]
                ends += [e for _, e in pieces]
            ints = [pa.array(v, pa.int32()) for v in (number, starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *ints], ["chunk_id", "piece_index", "start_token", "end_token"])

    # n tokens take at least 2n - 1 characters: shorter texts are left out before Python sees them
    large = chunks.filter(F.length(text_col) > 2 * limit).select(F.col(id_col).cast("string").alias("chunk_id"), F.col(text_col).alias("text"))
    pieces = large.mapInArrow(run, "chunk_id string, piece_index int, start_token int, end_token int")
    return pieces.distinct()


def split_oversized(chunks: DataFrame, limit: int = 300, overlap: int = 40, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(chunk_id, piece_index, start_token, end_token): own texts cut at the last paragraph, else sentence end."""
    return _split(chunks, lambda text: cut_greedy(text, limit, overlap), limit, id_col, text_col)


def split_by_content(chunks: DataFrame, limit: int = 300, overlap: int = 40, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(chunk_id, piece_index, start_token, end_token): own texts cut at content-defined landmarks."""
    return _split(chunks, lambda text: cut_by_content(text, limit, overlap), limit, id_col, text_col)
