"""TF-IDF search of every question in a whole corpus: exact, without a table of pairs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import cut_lineage, ensure_checkpoint_dir, parallelism

#: Documents of one block, and cells of its matrix of common terms at most.
BLOCK, CELLS = 4_096, 1 << 23
#: A term of more than one document in so many is common; questions of a task and of a product; pairs scored at once.
COMMON, TASK, BATCH, PAIRS = 256, 10_000, 128, 100_000
#: More than single precision and the rounding of a score can move it.
SLACK = 3e-5


def round_half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's ``round``: the shortest decimal text of a number, halves away from zero."""
    scaled = x * 10.0**digits
    whole = np.rint(scaled)
    broken = np.abs(scaled) < 2.0**52  # greater ones have no fraction
    for i in np.flatnonzero(broken)[np.abs(scaled[broken] - np.floor(scaled[broken]) - 0.5) < 1e-5 + np.abs(scaled[broken]) * 1e-15]:
        whole[i] = float(Decimal(repr(float(x[i]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(broken, whole / 10.0**digits, x)


def best_of(group: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each group, by score, then the smaller name; in that order. Repeated ones count once."""
    order = np.lexsort((name, -score, group))
    if len(order):
        a, b = order[1:], order[:-1]
        order = order[np.r_[True, (group[a] != group[b]) | (score[a] != score[b]) | (name[a] != name[b])]]
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[place < k]


def names_of(column: pa.Array) -> np.ndarray:
    """Ids that sort as Spark sorts them: bytes of texts, else numbers."""
    own = column.to_pylist()
    return np.array([x.encode() for x in own]) if own and isinstance(own[0], str) else np.array(own)


def texts_of(names: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Ids again of what ``names_of`` gave."""
    return pa.array([x.decode() for x in names.tolist()] if names.dtype.kind == "S" else names.tolist(), kind)


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after the other."""
    return np.arange(count.sum()) + np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def lookup(known: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted array, and whether they are there."""
    if not len(known):
        return np.zeros(len(value), int), np.zeros(len(value), bool)
    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
    return at, known[at] == value


def frequencies(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order, and the number of documents of each, on the driver."""
    rows = df.select("h", "df").toArrow()
    h, n = rows.column("h").to_numpy(), rows.column("df").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def bags(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms, tf): one row an id; words of two and more letters, digits or underscores of any script, lower case.

    A word is known by its 64-bit hash; terms are sorted.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("([\\p{L}\\p{N}_]{2,})"), F.lit(1))
    rows = texts.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.collect_list(text_col).alias("texts"))
    rows = rows.select("id", F.array_join("texts", "\n").alias(text_col)).select("id", F.transform(words, lambda w: F.xxhash64(w)).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, size = lists(b.column(1))
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((value, row))
            value, row = value[order], row[order]
            at = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, int)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row[at], minlength=len(size)))].astype(np.int32))
            tf = np.diff(np.r_[at, len(row)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(value[at], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(tf))], ["id", "terms", "tf"])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", texts.schema[id_col].dataType), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("tf", T.ArrayType(T.IntegerType()))]))


def tfidf_topk(corpus: DataFrame, questions: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """(query, id, score, rank) by cosine of TF-IDF with smoothed idf ln((1+n)/(1+df))+1.

    corpus and questions: (id, text).  candidates: optional (id) rows to choose from; idf
    counts the whole corpus all the same.

    The corpus is written once as an index of the terms that any question has. A task takes some
    questions through the whole index, so that its k best are final and no pairs are shuffled.
    First all documents that share a rare term with a question are scored; then all others by a
    product of matrices of common terms, unless the common part of the question is too short to
    reach its k-th score. What may belong to the k best is scored again in double precision.
    """
    spark = corpus.sparkSession
    ensure_checkpoint_dir(spark)
    docs, asks = cut_lineage(bags(corpus, "id", "text")), cut_lineage(bags(questions, "id", "text"))
    n, n_asks = docs.count(), asks.count()
    df = cut_lineage(docs.select(F.explode("terms").alias("h")).groupBy("h").agg(F.count("*").alias("df")))
    asked = frequencies(df.join(asks.select(F.explode("terms").alias("h")).distinct(), "h"))
    shared = spark.sparkContext.broadcast((*frequencies(df.filter("df > 1")), asked[0]))
    idf_of = lambda f: np.log((1 + n) / (1 + f)) + 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, freq, wanted = shared.value
        for b in batches:
            value, size = lists(b.column(1))
            tf, row = lists(b.column(2))[0], np.repeat(np.arange(len(size)), size)
            at, there = lookup(known, value)
            df = np.ones(len(value))  # a term that is not listed is in one document
            df[there] = freq[at[there]]
            w = tf * idf_of(df)
            length = np.sqrt(np.bincount(row, w * w, len(size)))
            at, some = lookup(wanted, value)
            counts = np.bincount(row[some], minlength=len(size))
            ends, kept = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(np.flatnonzero(counts))
            out = [b.column(0), pa.array(length), pa.ListArray.from_arrays(ends, pa.array(at[some].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf[some]))]
            yield pa.RecordBatch.from_arrays([c.take(kept) for c in out], ["id", "length", "terms", "tf"])

    kind, query_kind = corpus.schema["id"].dataType, questions.schema["id"].dataType
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tfidf-{uuid.uuid4().hex}"
    chosen = docs if candidates is None else docs.join(candidates, "id", "left_semi")
    ints = T.ArrayType(T.IntegerType())
    chosen.mapInArrow(index, T.StructType([T.StructField("id", kind), T.StructField("length", T.DoubleType()), T.StructField("terms", ints), T.StructField("tf", ints)])).write.parquet(place)
    files = spark.read.parquet(place).inputFiles()
    words, sizes = spark.sparkContext.broadcast(asked), (BLOCK, CELLS, COMMON, BATCH, PAIRS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if given:
            yield from _search(pa.Table.from_batches(given).combine_chunks().to_batches()[0], *words.value, idf_of, n, files, k, sizes)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """With the three rarest common terms of a question in one number."""
        vocabulary, freq = words.value
        for b in batches:
            value, size = lists(b.column(1))
            row, (at, known) = np.repeat(np.arange(len(size)), size), lookup(vocabulary, value)
            known[known] = freq[at[known]] > n / sizes[2]
            first = rarest(row[known], at[known], freq, len(size)) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(((first[0] << 21) + first[1] << 21) + first[2])], [*b.schema.names, "lead"])

    schema = T.StructType([T.StructField("query", query_kind), T.StructField("id", kind), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    alike = asks.mapInArrow(lead, T.StructType([*asks.schema, T.StructField("lead", T.LongType())]))
    return alike.repartitionByRange(max(parallelism(spark), -(-n_asks // TASK)), "lead", "id").mapInArrow(search, schema)


def rarest(row: np.ndarray, term: np.ndarray, freq: np.ndarray, n: int) -> np.ndarray:
    """The three rarest terms of each of n rows, -1 where there are fewer."""
    order = np.lexsort((term, freq[term], row)) if len(row) else np.zeros(0, int)
    row, term = row[order], term[order]
    begin = np.r_[0, np.cumsum(np.bincount(row, minlength=n))]
    out = np.full((3, n), -1, np.int64)
    for i in range(3):
        there = np.flatnonzero(np.diff(begin) > i)
        out[i, there] = term[begin[there] + i]
    return out


def _blocks(files: list[str], size: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs
    from pyarrow import parquet as pq

    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as f:
            yield from (b for b in pq.ParquetFile(f).iter_batches(size, use_threads=False) if b.num_rows)


def _search(given: pa.RecordBatch, vocabulary: np.ndarray, freq: np.ndarray, idf_of, n: int, files: list[str], k: int, sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The k best documents of every question of a task."""
    v = len(vocabulary)
    if not v:
        return
    most, cells, rarity, batch, pairs_at_once = sizes
    idf, common = idf_of(freq), freq > n / rarity
    value, size = lists(given.column(1))
    row, (at, known) = np.repeat(np.arange(len(size)), size), lookup(vocabulary, value)
    row, term, w = row[known], at[known], (lists(given.column(2))[0] * idf[at])[known]
    n_asks = len(size)
    length = np.sqrt(np.bincount(row, w * w, n_asks))
    w = w / length[row]
    begin = np.r_[0, np.cumsum(np.bincount(row, minlength=n_asks))]
    hot = common[term]
    hot_part = np.sqrt(np.bincount(row[hot], w[hot] ** 2, n_asks))
    # questions by rare term
    by_term = np.flatnonzero(~hot)[np.argsort(term[~hot], kind="stable")]
    ask_of, ask_begin = row[by_term], np.searchsorted(term[by_term], np.arange(v + 1))
    # questions of alike common terms, the rarest first, share a task and a batch
    hot_row, hot_term, hot_w = row[hot], term[hot], w[hot]
    hot_begin = np.r_[0, np.cumsum(np.bincount(hot_row, minlength=n_asks))]
    alike = np.lexsort(rarest(hot_row, hot_term, freq, n_asks)[::-1])
    hot_at = np.full(v, -1)
    hot_at[common] = np.arange(common.sum())
    block = int(np.clip(cells // max(1, common.sum()), 64, most))

    best_row, best_score, best_name = np.zeros(0, int), np.zeros(0), None
    least = np.full(n_asks, -1.0)

    def offer(a: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        nonlocal best_row, best_score, best_name
        score = round_half_up(score, 6)
        keep = score >= least[a]
        a, score, name = a[keep], score[keep], name[keep]
        if not len(a):
            return
        a, score, name = np.r_[best_row, a], np.r_[best_score, score], name if best_name is None else np.concatenate([best_name, name])
        top = best_of(a, score, name, k)
        best_row, best_score, best_name = a[top], score[top], name[top]
        full = np.flatnonzero(np.r_[best_row[k - 1 :] == best_row[: len(best_row) - k + 1]]) if len(best_row) >= k else np.zeros(0, int)
        least[best_row[full]] = best_score[full + k - 1]

    for dense in (False, True):
        for b in _blocks(files, block):
            terms, size = lists(b.column(2))
            doc = np.repeat(np.arange(len(size)), size)
            norm = b.column(1).to_numpy()
            dw = lists(b.column(3))[0] * idf[terms] / norm[doc]
            keys = doc * v + terms
            is_hot = common[terms]

            names = names_of(b.column(0))
            name_type = b.column(0).type

            def score(pairs_a: np.ndarray, pairs_d: np.ndarray) -> None:
                """Whole scores of pairs of questions and documents."""
                for low in range(0, len(pairs_a), pairs_at_once):
                    a, d = pairs_a[low : low + pairs_at_once], pairs_d[low : low + pairs_at_once]
                    count = begin[a + 1] - begin[a]
                    q = spans(begin[a], count)
                    at, there = lookup(keys, np.repeat(d, count) * v + term[q])
                    offer(a, np.bincount(np.repeat(np.arange(len(a)), count), np.where(there, dw[at] * w[q], 0.0), len(a)), names[d])

            if not dense:
                t, d = terms[~is_hot], doc[~is_hot]
                count = ask_begin[t + 1] - ask_begin[t]
                pairs = np.unique(ask_of[spans(ask_begin[t], count)] * np.int64(block) + np.repeat(d, count))
                score(*np.divmod(pairs, block))
                continue
            some = int(is_hot.sum())
            if not some:
                continue
            reach = np.sqrt(np.bincount(doc[is_hot], dw[is_hot] ** 2, len(size)).max())
            open_ = alike[(hot_part[alike] > 0) & (hot_part[alike] * reach + SLACK >= least[alike])]
            matrix = np.zeros((int(common.sum()), len(size)), np.float32)
            matrix[hot_at[terms[is_hot]], doc[is_hot]] = dw[is_hot]
            found_a, found_d = [], []
            for low in range(0, len(open_), batch):
                part = open_[low : low + batch]
                count = hot_begin[part + 1] - hot_begin[part]
                q = spans(hot_begin[part], count)
                used, col = np.unique(hot_at[hot_term[q]], return_inverse=True)
                weight = np.zeros((len(part), len(used)), np.float32)
                weight[np.repeat(np.arange(len(part)), count), col] = hot_w[q]
                s = weight @ matrix[used]
                limit = least[part] - SLACK
                few = limit < 0  # fewer than k so far
                if few.any():
                    limit[few] = (np.partition(s[few], -k, axis=1)[:, -k] if s.shape[1] >= k else 0.0) - SLACK
                a, d = np.divmod(np.flatnonzero((s >= np.maximum(limit, 1e-12).astype(np.float32)[:, None]).ravel()), s.shape[1])
                found_a.append(part[a])
                found_d.append(d)
                if sum(map(len, found_a)) > pairs_at_once or low + batch >= len(open_):
                    score(np.concatenate(found_a), np.concatenate(found_d))
                    found_a, found_d = [], []
    if len(best_row):
        first = np.flatnonzero(np.r_[True, best_row[1:] != best_row[:-1]])
        place = np.arange(len(best_row)) - np.repeat(first, np.diff(np.r_[first, len(best_row)])) + 1
        yield pa.RecordBatch.from_arrays([given.column(0).take(pa.array(best_row)), texts_of(best_name, name_type), pa.array(best_score), pa.array(place.astype(np.int32))], ["query", "id", "score", "rank"])
