"""Documents to chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import hash_id, strip, tokens

#: Where texts are cut, the strongest first.
SEPARATORS = ["\n\n", "\r\n\r\n", "\n", "\r\n", "。", "．", ".", "！", "!", "？", "?", " ", "\t", "\u3000", "\u200b"]


def dedup_documents(documents: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(hash, content, first_id, copies): documents of equal trimmed text are one; null and blank texts are none."""
    rows = documents.select(F.col(order).alias("first_id"), strip(F.col(text)).alias("content")).filter("content <> ''")
    grouped = rows.withColumn("hash", hash_id("doc-", F.col("content"))).groupBy("hash")
    return grouped.agg(F.first("content").alias("content"), F.min("first_id").alias("first_id"), F.count("*").alias("copies"))


def token_windows(documents: DataFrame, size: int = 64, overlap: int = 16, key: str = "hash", text: str = "content") -> DataFrame:
    """(key, pos, tokens, content): every start below the length opens a window, so a last window may lie in the overlap."""
    stride = size - overlap
    rows = documents.select(key, tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    opened = rows.select(key, "t", F.posexplode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(stride))).alias("pos", "start"))
    window = F.slice("t", F.col("start") + 1, F.lit(size))
    return opened.select(key, "pos", F.size(window).alias("tokens"), F.array_join(window, " ").alias("content"))


def with_chunk_ids(windows: DataFrame, key: str = "hash") -> DataFrame:
    """Content-hash ids; the first chunk of equal content stays."""
    rows = windows.withColumn("chunk_id", hash_id("chunk-", F.col("content")))
    first = Window.partitionBy("chunk_id").orderBy(key, "pos")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def running_index(rows: DataFrame, *order: str, start: int = 0, name: str = "chunk_index") -> DataFrame:
    """Dense numbers in a total order, without one task seeing all rows.

    Rows are range-partitioned by the order; each takes the rows of all partitions before it.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (own + F.col("_before") + start - 1).cast("bigint")).drop("_part", "_before")


def split_increment(rows: DataFrame, ratio: float, *order: str) -> DataFrame:
    """All rows with is_new: whether they are among the last int(n * ratio) of the order."""
    from graphloom.session import cut_lineage

    numbered = cut_lineage(running_index(rows, *order, name="_at"))
    n = numbered.count()
    return numbered.withColumn("is_new", F.col("_at") >= n - int(n * ratio)).drop("_at")


def new_documents(documents: DataFrame, known: DataFrame, key: str = "hash", known_key: str = "doc_id") -> DataFrame:
    """Documents whose id is not there yet."""
    return documents.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


def _cut(text: str) -> list[str]:
    """Parts of a text, each with the separator it ends at."""
    pattern = "|".join(re.escape(s) for s in SEPARATORS)
    return [p for p in re.findall(rf".+?(?:{pattern})|.+$", text, re.S) if p]


def merge_parts(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """(first, end) of the greedy runs of parts within the limit; a part over it stands alone."""
    runs, first, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            runs.append((first, i))
            first, total = i, 0
        total += size
    if first < len(sizes):
        runs.append((first, len(sizes)))
    return runs


def separator_chunks(documents: DataFrame, size: int = 64, overlap: int = 8, key: str = "hash", text: str = "content") -> DataFrame:
    """(key, pos, tokens, content): parts at separators, merged up to the size, with the last overlap tokens of the chunk before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pos, counts, contents = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [p.split() for p in _cut(t or "")]
                parts = [p for p in parts if p]
                pieces: list[list[str]] = []
                for first, end in merge_parts([len(p) for p in parts], size):
                    words = [w for p in parts[first:end] for w in p]
                    step = size - overlap
                    windows = [words[i : i + size] for i in range(0, len(words), step)] if len(words) > size else [words]
                    pieces += [w for i, w in enumerate(windows) if i == 0 or len(w) > overlap]
                for i, words in enumerate(pieces):
                    tail = pieces[i - 1][-overlap:] if i and overlap else []
                    full = (tail + words)[:size]
                    keys.append(k)
                    pos.append(i)
                    counts.append(len(full))
                    contents.append(" ".join(full))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pos, pa.int32()), pa.array(counts, pa.int32()), pa.array(contents, pa.string())], [key, "pos", "tokens", "content"])

    return documents.select(F.col(key).cast("string"), text).mapInArrow(run, f"{key} string, pos int, tokens int, content string")


#: Chunking methods by name: DataFrame -> DataFrame.
METHODS: dict[str, Callable[..., DataFrame]] = {"token_size": token_windows, "separator": separator_chunks}


def register_method(name: str, method: Callable[..., DataFrame]) -> None:
    METHODS[name] = method
