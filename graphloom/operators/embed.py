"""Text embeddings, their index on disk, and search by kind of owner."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.retrieval import exact_knn, ranked

#: Width of the offline embedding.
WIDTH = 256
#: An embedding provider maps a batch of texts to one vector each; a zero vector means that a text says nothing.
Embedder = Callable[[list[str]], np.ndarray]

_WORD = re.compile(r"[^\W_]{2,}")


@lru_cache(500_000)
def _slot(word: str) -> tuple[int, int]:
    """Column and sign of a word, from its md5."""
    digest = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
    return int(digest[:4], 16) % WIDTH, 1 if digest[4] in "02468ace" else -1


def hashing_embedder(texts: list[str]) -> np.ndarray:
    """The offline provider: signed counts of words of two and more characters in hashed columns."""
    out = np.zeros((len(texts), WIDTH))
    for row, text in zip(out, texts):
        for word in _WORD.findall(text.lower()):
            column, sign = _slot(word)
            row[column] += sign
    return out


def fit_width(x: np.ndarray, width: int) -> np.ndarray:
    """Vectors cut or padded with zeros to a width."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def embed_texts(rows: DataFrame, text: str = "text", provider: Embedder = hashing_embedder, width: int = WIDTH, batch: int = 256) -> DataFrame:
    """All columns but the text, and ``embedding``: unit vectors of a given width, one pass, nothing shuffled.

    Null and blank texts, and texts whose vector is zero or not finite, have no row.
    """
    keep = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", embedding array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            for low in range(0, len(texts), batch):
                part = texts[low : low + batch]
                x = fit_width(np.asarray(provider(part), np.float64), width)
                norm = np.linalg.norm(x, axis=1)
                sound = np.flatnonzero(np.isfinite(norm) & (norm > 0))
                at = pa.array(sound + low)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keep))), pa.array((x[sound] / norm[sound, None]).tolist(), pa.list_(pa.float64()))], [*keep, "embedding"])

    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return rows.select(*keep, said.alias(text)).filter(F.length(F.trim(text)) > 0).mapInArrow(run, schema)


def node_texts(nodes: DataFrame, chunks: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, kind, text): chunk contents, ``name. description`` of entities, summaries of communities; one row an id."""
    entity = nodes.filter((F.col("node_type") == "entity") & F.col("node_id").isNotNull()).select(
        F.col("node_id").alias("id"), F.lit("entity").alias("kind"), F.concat_ws(". ", "entity_name", F.nullif("description", F.lit(""))).alias("text")
    )
    chunk = chunks.filter("chunk_id is not null").select(F.concat(F.lit("CHUNK_"), "chunk_id").alias("id"), F.lit("chunk").alias("kind"), F.coalesce("content", F.lit("")).alias("text"))
    community = communities.filter("community_id is not null").select(F.col("community_id").alias("id"), F.lit("community").alias("kind"), F.coalesce("summary", F.lit("")).alias("text"))
    return entity.unionByName(chunk).unionByName(community).groupBy("id", "kind").agg(F.max("text").alias("text"))


def save_index(vectors: DataFrame, path: str, kind: str = "kind") -> None:
    """The index of all kinds, one folder a kind, so that a search reads only its own."""
    vectors.write.mode("overwrite").partitionBy(kind).parquet(path)


def load_index(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    index = spark.read.parquet(path)
    return index if kind is None else index.filter(F.col("kind") == kind)


def refresh_index(spark: SparkSession, path: str, changed: DataFrame, target: str) -> None:
    """A new index of old rows without the changed ids, and the changed rows; the old one stays readable."""
    old = load_index(spark, path)
    kept = old.join(changed.select("id", "kind").distinct(), ["id", "kind"], "left_anti")
    save_index(kept.unionByName(changed.select(*kept.columns)), target)


def typed_knn(index: DataFrame, questions: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(query_id, kind, id, rank, score): the nearest of each kind, as many as its quota says.

    index: (id, kind, embedding); questions: (query_id, embedding).
    """
    asked = questions.select(F.col("query_id").cast("string").alias("id"), "embedding")
    found: DataFrame | None = None
    for kind, k in quotas.items():
        near = exact_knn(index.filter(F.col("kind") == kind).select("id", "embedding"), asked, k, "id", "embedding")
        near = near.select(F.col("query").cast("bigint").alias("query_id"), F.lit(kind).alias("kind"), "id", "rank", F.round("score", 9).alias("score"))
        found = near if found is None else found.unionByName(near)
    return found


def member_entities(retrieval: DataFrame, communities: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, node): entities among the members of a query's communities; ids agree as ``id_key`` says."""
    from graphloom.operators.hierarchy import id_key

    listed = communities.select(F.col("community_id").alias("id"), F.explode("members").alias("member")).select("id", id_key(F.col("member")).alias("key"))
    named = entities.select(F.col("id").alias("node"), id_key(F.col("id")).alias("key")).distinct()
    chosen = retrieval.filter("kind = 'community'").select("query_id", "id")
    return chosen.join(listed, "id").join(named, "key").select("query_id", "node").distinct()


def related_edges(pool: DataFrame, edges: DataFrame, questions: DataFrame, chunk_ids: DataFrame, k: int) -> DataFrame:
    """(query_id, src, dst, place): edges from a query's entities to nodes that are no chunks, nearest to the question first.

    Edges are embedded only where a pool reaches them.
    """
    reached = pool.select(F.col("node").alias("src")).distinct()
    text = F.concat_ws(" ", F.array_join("relation_names", " "), "description")
    near = edges.join(reached, "src", "left_semi").join(chunk_ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    said = embed_texts(near.select("src", "dst", text.alias("text")).groupBy("src", "dst").agg(F.max("text").alias("text")))
    dot = F.aggregate(F.zip_with("embedding", "asked", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = pool.withColumnRenamed("node", "src").join(said, "src").join(questions.select("query_id", F.col("embedding").alias("asked")), "query_id")
    scored = rows.select("query_id", F.lit("relation").alias("kind"), F.concat_ws("|", "src", "dst").alias("id"), "src", "dst", F.round(dot, 9).alias("score"), F.lit(None).cast("int").alias("rank"))
    best = ranked(scored).filter(F.col("pos") <= k).select("query_id", "id", F.col("pos").alias("place"))
    return best.join(scored.select("query_id", "id", "src", "dst").distinct(), ["query_id", "id"]).select("query_id", "src", "dst", "place")
