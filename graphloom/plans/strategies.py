"""Query strategies: named compositions of retrieval operators, and the rest of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import context, graph, merge, retrieval, steiner, trees
from graphloom.plans.graphs import seeds
from graphloom.plans.queries import RANKED, TOK
from graphloom.plans.registry import query
from graphloom.session import cut_lineage, table


def basic_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, section, a, b, place): entities, their relations under a budget, and their chunks."""
    found = table(spark, sf_dir, "retrieval")
    edges = table(spark, sf_dir, "edges")
    entities = retrieval.ranked(found).filter("kind = 'entity'").select("query_id", F.lit("entity").alias("section"), F.col("id").alias("a"), F.lit("").alias("b"), F.col("pos").alias("place"))
    relations = retrieval.relations_of_seeds(found, edges, graph.edge_degree(edges), merge.edge_text(edges), 60).select("query_id", F.lit("relation").alias("section"), F.col("src").alias("a"), F.col("dst").alias("b"), "place")
    order = Window.partitionBy("query_id").orderBy("first_pos", F.desc("n_seeds"), "chunk")
    chunks = retrieval.chunks_of_seeds(found, merge.entity_chunks(table(spark, sf_dir, "nodes"))).withColumn("place", F.row_number().over(order))
    return entities.unionByName(relations).unionByName(chunks.select("query_id", F.lit("chunk").alias("section"), F.col("chunk").alias("a"), F.lit("").alias("b"), "place"))


def passage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, score): chunks by personalised PageRank from the retrieved entities."""
    from graphloom.plans.graphs import chunk_ppr_converged

    return chunk_ppr_converged(spark, sf_dir)


def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): edges within two hops of the retrieved entities."""
    edges = table(spark, sf_dir, "edges")
    ball = cut_lineage(graph.k_hop(edges, seeds(spark, sf_dir), 2, mode="ball"))
    return graph.induced_subgraph(edges, ball).select("src", "dst").distinct()


def flat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hierarchical_flat_search(table(spark, sf_dir, "retrieval"), 5)


#: Strategy name -> composition, as a session and a data directory give it.
STRATEGIES = {"basic_local": basic_local, "ppr": passage_rank, "two_hop": subgraph, "flat_tree": flat_tree}


@query()
def strategy_basic_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic_local(spark, sf_dir)


@query()
def strategy_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subgraph(spark, sf_dir)


@query()
def pcst_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    prizes = retrieval.steiner_prizes(table(spark, sf_dir, "retrieval").filter("kind = 'entity'"), 10).select("query_id", "id", "prize")
    return steiner.steiner_subgraphs(table(spark, sf_dir, "edges"), prizes)


@query()
def soft_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return trees.build_layers(rows, lambda layer: trees.soft_clusters(layer), layers=2)


@query()
def balanced_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return trees.balanced_clusters(rows, 50)


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").groupBy(F.concat(F.lit("CHUNK_"), "chunk_id").alias("id")).agg(F.min(F.coalesce("content", F.lit(""))).alias("content"))


_CH = "ch AS (SELECT 'CHUNK_' || chunk_id AS id, min(coalesce(content, '')) AS content FROM chunks GROUP BY 1)"


@query(
    f"""WITH {RANKED}, {_CH}, s AS (SELECT community_id AS id, coalesce(max(level), 0) AS level, coalesce(max(summary), '') AS summary FROM communities GROUP BY 1),
    co AS (SELECT query_id, count(*) AS n, sum(least(length(summary), 3000)) AS size FROM (SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY pos) AS n FROM rk JOIN s USING (id) WHERE kind = 'community') WHERE n = 1 GROUP BY 1),
    en AS (SELECT query_id, count(*) AS n, sum(length(id)) AS size FROM rk WHERE kind = 'entity' AND pos <= 150 GROUP BY 1),
    us AS (SELECT query_id, sum(size) AS before FROM (SELECT query_id, size FROM co UNION ALL SELECT query_id, size FROM en) GROUP BY 1),
    dk AS (SELECT query_id, length(content) AS size, coalesce(before, 0) + sum(length(content)) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total FROM rk JOIN ch USING (id) LEFT JOIN us USING (query_id) WHERE kind = 'chunk')
    SELECT query_id, 'communities' AS section, n, CAST(size AS BIGINT) AS size FROM co UNION ALL SELECT query_id, 'entities', n, CAST(size AS BIGINT) FROM en UNION ALL SELECT query_id, 'documents', count(*), CAST(sum(size) AS BIGINT) FROM dk WHERE total <= 4000 GROUP BY 1"""
)
def sectioned_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = table(spark, sf_dir, "communities").groupBy(F.col("community_id").alias("id")).agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"), F.coalesce(F.max("summary"), F.lit("")).alias("summary"))
    sizes = _chunk_rows(spark, sf_dir).select("id", F.length("content").alias("size"))
    return context.sectioned(retrieval.ranked(table(spark, sf_dir, "retrieval")), summaries, sizes)


@query(f"WITH {_CH} SELECT id, md5(array_to_string(list_filter(string_split_regex(content, '[ \\t\\r\\n]+'), lambda t: t <> '')[1:50], ' ')) AS head FROM ch WHERE id IS NOT NULL")
def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir).filter("id is not null").select("id", F.md5(context.truncate(F.col("content"), 50)).alias("head"))


@query()
def budget_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _chunk_rows(spark, sf_dir).select("id", tx.token_count(F.col("content")).alias("tokens"))
    rows = retrieval.ranked(table(spark, sf_dir, "retrieval")).filter("kind = 'chunk'").join(sizes, "id").select("query_id", "id", "pos", "tokens")
    return context.budget_groups(rows, 400, ["pos"], "tokens", ["query_id"])


@query(
    f"""WITH {RANKED}, {_CH}, t AS (SELECT query_id, kind, rk.id, pos, CASE WHEN kind = 'chunk' THEN {TOK.format("content")} ELSE 4 END AS tokens FROM rk LEFT JOIN ch ON ch.id = rk.id),
    e AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM t WHERE kind = 'entity'), ek AS (SELECT * FROM e WHERE used <= 20),
    sp AS (SELECT query_id, 20 - coalesce(max(used), 0) AS spare FROM (SELECT DISTINCT query_id FROM t) LEFT JOIN ek USING (query_id) GROUP BY 1),
    c AS (SELECT t.*, spare, sum(tokens) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM t JOIN sp USING (query_id) WHERE kind = 'chunk')
    SELECT query_id, kind, id, pos FROM ek UNION ALL SELECT query_id, kind, id, pos FROM c WHERE used <= 300 + spare"""
)
def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _chunk_rows(spark, sf_dir).select("id", tx.token_count(F.col("content")).alias("size"))
    rows = retrieval.ranked(table(spark, sf_dir, "retrieval")).join(sizes, "id", "left")
    rows = rows.select("query_id", "kind", "id", "pos", F.when(F.col("kind") == "chunk", F.coalesce("size", F.lit(0))).otherwise(4).alias("tokens"))
    return context.pack_shared(rows, {"entity": 20, "chunk": 300}).select("query_id", "kind", "id", "pos")


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def micro_batch_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inserted as a stream of files; equal to the batch result."""
    import uuid

    from graphloom.session import ensure_checkpoint_dir
    from graphloom.streaming import micro_batch

    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).select("user_id", "ts", "event_id", "event_type").schema
    stream = micro_batch.file_stream(spark, path, schema).select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    micro_batch.insert_stream(stream, f"{place}/state", f"{place}/checkpoint", "user_id", "at")
    return micro_batch.current_state(spark, f"{place}/state", "user_id", "at").select("user_id", "at.event_id", "at.ts", "event_type")


@query("SELECT src, dst, max(coalesce(weight, 0)) AS weight FROM edges GROUP BY 1, 2")
def graphml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as GraphML and read back."""
    import uuid

    from graphloom.session import ensure_checkpoint_dir
    from graphloom.sources import io

    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/graphml-{uuid.uuid4().hex}"
    io.write_graphml(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"), place)
    return io.read_graphml(spark, place)[1]


@query("SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.streaming import micro_batch

    return micro_batch.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"])


@query("SELECT user_id, event_id, event_type, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3")
def memory_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three messages of every conversation."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("place", F.row_number().over(order)).filter("place <= 3").select("user_id", "event_id", "event_type", "place")
