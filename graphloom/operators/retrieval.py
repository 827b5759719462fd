"""Retrieval operators over (query_id, kind, rank, id, score) tables.

Repeated rows count once; null ranks come last and null scores count as the lowest; of equal
positions the smaller id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import token_count
from graphloom.operators.tfidf import best_of, names_of, round_half_up, texts_of

#: Query vectors of one pass over the collection.
QUERIES_A_PASS = 4_096
#: Products of queries and rows at a time, in all and in double precision.
PRODUCTS, PAIRS = 1 << 22, 20_000
#: Rows of ids and numbers that are broadcast, at most.
BROADCAST_ROWS = 300_000


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """(query, id, score, rank): the k greatest inner products of each query against all rows, itself left out.

    Queries go round in blocks of bounded size; each task keeps its k best of every query,
    so that only k rows a task and query are shuffled. Products are made for some rows at a time in
    single precision; those that may be among the k best are made again in double precision.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    usable = F.col(vec_col).isNotNull()
    rows = vectors.filter(usable).select(id_col, vec_col)
    found: DataFrame | None = None
    block: list = []

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([b[0] for b in block], np.array([b[1] for b in block], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, q = shared.value
            best = _Best(asked, q, k)
            for batch in batches:
                for low in range(0, batch.num_rows, best.rows):
                    best.meet(batch.slice(low, best.rows))
            yield from best.out()

        return rows.mapInArrow(run, schema)

    for row in queries.filter(usable).select(id_col, vec_col).toLocalIterator():
        block.append((row[0], list(row[1])))
        if len(block) == QUERIES_A_PASS:
            part, block = search(block), []
            found = part if found is None else found.unionByName(part)
    if block or found is None:
        part = search(block) if block else spark.createDataFrame([], schema)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Best:
    """The k best rows of every query so far, by rounded score, then the smaller id."""

    def __init__(self, asked: list, q: np.ndarray, k: int) -> None:
        self.asked, self.q, self.k = asked, q, k
        self.own: dict = {}
        for i, a in enumerate(asked):
            self.own.setdefault(a, []).append(i)
        self.small = bool(np.abs(q[np.isfinite(q)]).max(initial=0) < 1e15)
        self.single = q.astype(np.float32) if self.small else q
        self.norm = np.sqrt((q * q).sum(1))
        self.least = np.full(len(asked), -np.inf)
        self.query, self.score, self.name = np.zeros(0, int), np.zeros(0), None
        self.kind = None
        self.rows = max(16, PRODUCTS // len(asked))

    def meet(self, batch: pa.RecordBatch) -> None:
        ids = batch.column(0)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        sound = np.isfinite(x).all(1)  # no other row has a finite product
        if not sound.all():
            ids, x = ids.take(pa.array(np.flatnonzero(sound))), x[sound]
        if not len(ids):
            return
        q, y = (self.single, x.astype(np.float32)) if self.small and np.abs(x).max(initial=0) < 1e15 else (self.q, x)
        s = q @ y.T
        # what single precision can be wrong by
        slack = 1e-8 + 2e-7 * (4 + x.shape[1] ** 0.5) * self.norm * np.sqrt((x * x).sum(1).max())
        names, limit, new = names_of(ids), self.least - slack, ~np.isfinite(self.least)
        if new.any():
            some, once = self.k + 1, np.unique(names, return_index=True)[1]  # one may be the query itself
            if len(once) > some:
                t = s[new] if len(once) == len(names) else s[new][:, once]
                limit[new] = np.partition(t, -some, axis=1)[:, -some] - 2 * slack[new]
        a, b = np.divmod(np.flatnonzero((s >= limit.astype(s.dtype)[:, None]).ravel()), len(ids))
        mine = [i * len(ids) + n for n, v in enumerate(ids.to_pylist()) for i in self.own.get(v, ())]
        if mine:
            other = ~np.isin(a * len(ids) + b, mine)
            a, b = a[other], b[other]
        self.kind = ids.type
        for low in range(0, len(a), PAIRS):
            self.offer(a[low : low + PAIRS], x[b[low : low + PAIRS]], names[b[low : low + PAIRS]])

    def offer(self, a: np.ndarray, x: np.ndarray, name: np.ndarray) -> None:
        score = np.einsum("ij,ij->i", self.q[a], x)
        keep = np.isfinite(score)
        keep[keep] = round_half_up(score[keep], 9) >= self.least[a[keep]]
        a, score, name = a[keep], score[keep], name[keep]
        if not len(a):
            return
        if self.name is not None:
            a, score, name = np.r_[self.query, a], np.r_[self.score, score], np.concatenate([self.name, name])
        rounded = round_half_up(score, 9)
        top = best_of(a, rounded, name, self.k)
        self.query, self.score, self.name, rounded = a[top], score[top], name[top], rounded[top]
        full = np.flatnonzero(self.query[self.k - 1 :] == self.query[: max(0, len(top) - self.k + 1)])
        self.least[self.query[full]] = rounded[full + self.k - 1]

    def out(self) -> Iterator[pa.RecordBatch]:
        if len(self.query):
            asked = pa.array([self.asked[i] for i in self.query], self.kind)
            yield pa.RecordBatch.from_arrays([asked, texts_of(self.name, self.kind), pa.array(self.score)], ["query", "id", "score"])


def max_similarity(vectors: DataFrame, queries: DataFrame, doc_col: str, vec_col: str) -> DataFrame:
    """(query, doc, score): for each query text the best products of its token vectors within a document, added up.

    queries: (query, vector), in blocks of bounded size against all rows; each task sends one
    row a token and document.
    """
    spark = vectors.sparkSession
    found: DataFrame | None = None

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((block, np.array([b[2] for b in block], np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                docs = np.array(batch.column(0).to_pylist(), object)
                s = q @ np.array(batch.column(1).to_pylist(), np.float64).T
                names, at = np.unique(docs.astype(str), return_inverse=True)
                best = np.full((len(asked), len(names)), -np.inf)
                np.maximum.at(best.T, at, s.T)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([str(b[0]) for b in asked], len(names)).tolist()), pa.array(np.repeat([b[1] for b in asked], len(names))), pa.array(np.tile(names, len(asked)).tolist()), pa.array(best.ravel())],
                    ["query", "token", "doc", "best"],
                )

        return vectors.filter(F.col(vec_col).isNotNull()).select(doc_col, vec_col).mapInArrow(run, "query string, token bigint, doc string, best double")

    block: list = []
    for n, row in enumerate(queries.toLocalIterator()):
        block.append((row[0], n, list(row[1])))
        if len(block) == QUERIES_A_PASS:
            part, block = search(block), []
            found = part if found is None else found.unionByName(part)
    if block:
        part = search(block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query string, doc string, score double")
    return found.groupBy("query", "token", "doc").agg(F.max("best").alias("best")).groupBy("query", "doc").agg(F.sum("best").alias("score"))


def ranked(retrieval: DataFrame) -> DataFrame:
    """Distinct retrieval rows with a dense position: by score, then id."""
    rows = retrieval.filter("query_id is not null and id is not null").groupBy("query_id", "kind", "id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc(F.coalesce("score", F.lit(-1e9))), "id")
    return rows.withColumn("pos", F.row_number().over(order))


def budget_prefix(rows: DataFrame, budget: int, partition: list[str], order: list[Column], tokens: Column) -> DataFrame:
    """Rows in order as long as their tokens fit; the first that does not fit ends the list."""
    running = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(tokens).over(running)).filter(F.col("used") <= budget)


def hierarchical_flat_search(retrieval: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, kind, id, place): one list of chunks and communities by score under their quotas, and k entities.

    Of the k best chunks, k best communities and 5k best entities: at most max(1, k/5)
    communities, communities and chunks at most k together; entities keep their own k.
    """
    rows = ranked(retrieval)
    pool = rows.filter(((F.col("kind") == "entity") & (F.col("pos") <= 5 * k)) | ((F.col("kind") != "entity") & (F.col("pos") <= k)))
    quota = pool.filter((F.col("kind") != "community") | (F.col("pos") <= max(1, k // 5)))
    mixed = quota.filter("kind in ('chunk', 'community')").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(-1e9))), "kind", "id")))
    entities = quota.filter("kind = 'entity'").withColumn("place", F.col("pos"))
    return mixed.unionByName(entities).filter(F.col("place") <= k).select("query_id", "kind", "id", "place")


def relations_of_seeds(retrieval: DataFrame, edges: DataFrame, degree: DataFrame, texts: DataFrame, budget: int = 60) -> DataFrame:
    """(query_id, src, dst, place): edges at a query's entities, by edge degree and weight, within a token budget."""
    seeds = retrieval.filter("kind = 'entity' and query_id is not null").select("query_id", F.col("id").alias("node")).distinct()
    ends = edges.groupBy("src", "dst").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    ends = ends.join(degree, ["src", "dst"]).join(texts.groupBy("src", "dst").agg(F.min("text").alias("text")), ["src", "dst"])
    both = ends.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "src", "dst", "weight", "degree", token_count(F.col("text")).alias("tokens"))
    rows = seeds.join(both, "node").select("query_id", "src", "dst", "weight", "degree", "tokens").distinct()
    order = [F.desc("degree"), F.desc("weight"), F.col("src"), F.col("dst")]
    kept = budget_prefix(rows, budget, ["query_id"], order, F.col("tokens"))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).select("query_id", "src", "dst", "place")


def chunks_of_seeds(retrieval: DataFrame, mentions: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, chunk, first_pos, n_seeds): chunks that mention a query's entities; the first seed's position wins."""
    seeds = ranked(retrieval).filter("kind = 'entity'").select("query_id", F.col("id").alias("entity"), "pos")
    rows = seeds.join(mentions, "entity").groupBy("query_id", "chunk").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_seeds"))
    if limit is None:
        return rows
    order = Window.partitionBy("query_id").orderBy("first_pos", F.desc("n_seeds"), "chunk")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def strongest(edges: DataFrame, m: int, by_name: bool = False) -> DataFrame:
    """(node, other, weight): the m neighbours of greatest weight, of equal ones the smaller id; by_name: also the m smallest ids.

    An undirected edge counts from both ends, with its greatest weight; self-links are left out.
    """
    rows = edges.filter("src <> dst").select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    both = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    ways = rows.select(F.explode(both).alias("e"), "weight").groupBy("e.node", "e.other").agg(F.greatest(F.max("weight"), F.lit(0.001)).alias("weight"))
    first = lambda *order: ways.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(*order))).filter(F.col("n") <= m).drop("n")
    heavy = first(F.desc("weight"), "other")
    return heavy.unionByName(first("other")).distinct() if by_name else heavy


def beam_search(edges: DataFrame, seeds: DataFrame, width: int = 3, depth: int = 3) -> DataFrame:
    """(seed, step, node, score): from each seed the ``width`` best paths by product of edge weights, ``depth`` steps.

    A seed has visited width * (depth - 1) + 1 nodes at most, so that of a node's neighbours only
    the strongest width * depth + 1 can be among its best moves: a hub sends no more than these.
    They are written once.
    """
    import uuid

    from graphloom.session import cut_lineage, ensure_checkpoint_dir

    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    greatest = edges.agg(F.max("weight")).head()[0]
    # where a product is no finite number, all neighbours tie and the smaller id goes first
    endless = greatest is not None and not abs(greatest) < np.finfo(np.float64).max ** (1 / depth)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/near-{uuid.uuid4().hex}"
    strongest(edges, width * depth + 1, endless).write.parquet(place)
    near = spark.read.parquet(place)
    front = seeds.select(F.col("node").alias("seed"), "node", F.lit(1.0).alias("score"))
    visited = front.select("seed", "node")
    size = front.count()
    out = None
    for step in range(1, depth + 1):
        own = F.broadcast(front) if size <= BROADCAST_ROWS else front
        moves = near.join(own, "node").select("seed", F.col("other").alias("node"), (F.col("score") * F.col("weight")).alias("score"))
        moves = moves.join(visited, ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.max("score").alias("score"))
        best = Window.partitionBy("seed").orderBy(F.desc("score"), "node")
        front = cut_lineage(moves.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= width).drop("n"))
        size = front.count()
        visited = visited.unionByName(front.select("seed", "node"))
        part = front.withColumn("step", F.lit(step))
        out = part if out is None else out.unionByName(part)
    return out


def steiner_prizes(retrieval: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, id, prize): prizes top..1 by position; equal scores share the mean of their prizes."""
    rows = ranked(retrieval).filter(F.col("pos") <= top)
    tied = Window.partitionBy("query_id", "kind", "score")
    return rows.select("query_id", "kind", "id", F.round(F.avg(top + 1 - F.col("pos")).over(tied), 6).alias("prize"))
