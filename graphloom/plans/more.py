"""Further retrieval, report and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import vectors as vx
from graphloom.operators import evaluate, graph, incremental, merge, retrieval, trees
from graphloom.operators.chunking import running_index
from graphloom.operators.hierarchy import id_key
from graphloom.plans.graphs import ADJ, DEG, SEEDS, seeds
from graphloom.plans.queries import GOLD, KEY, RANKED, RELATIONS
from graphloom.plans.registry import query
from graphloom.session import table

KNN = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_dot_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM s)"""


def _knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.exact_knn(vectors, vectors.filter("vec_id % 50 = 0"), k, "vec_id", "embedding")


@query(f"WITH {KNN} SELECT query, id, round(score, 6) AS score FROM k WHERE rank = 1")
def link_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 1).select("query", "id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {KNN}, t AS (SELECT * FROM k WHERE rank <= 5), b AS (SELECT query, max(score) AS top FROM t GROUP BY 1)
    SELECT least(query, id) AS src, greatest(query, id) AS dst, 'similarity' AS relation, round(max(score / top), 6) AS weight FROM t JOIN b USING (query) WHERE score / nullif(top, 0) >= 0.8 GROUP BY 1, 2"""
)
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _knn(spark, sf_dir, 5).select(F.col("query").alias("owner"), F.col("id").alias("other"), F.col("score").alias("cosine"))
    return merge.similarity_edges(near, 0.8).withColumn("weight", F.round("weight", 6))


@query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT q.label AS query, q.vec_id, d.label AS doc, max(list_dot_product(q.e, d.e)) AS best FROM v q, v d WHERE q.vec_id % 50 = 0 GROUP BY 1, 2, 3)
    SELECT query, doc, round(sum(best), 5) AS score FROM m GROUP BY 1, 2"""
)
def maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction: every query token's best product within a document, added up; rows of a label are one text."""
    rows = table(spark, sf_dir, "embeddings")
    found = retrieval.max_similarity(rows, rows.filter("vec_id % 50 = 0").select("label", "embedding"), "label", "embedding")
    return found.select(F.col("query").cast("int").alias("query"), F.col("doc").cast("int").alias("doc"), F.round("score", 5).alias("score"))


@query(f"WITH {RANKED} SELECT rk.query_id, rk.kind, rk.id, n.node_type, coalesce(n.entity_type, '') AS entity_type FROM rk JOIN (SELECT node_id, max(node_type) AS node_type, max(lower(entity_type)) AS entity_type FROM nodes GROUP BY 1) n ON n.node_id = rk.id")
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of retrieval with what the graph holds of them."""
    info = table(spark, sf_dir, "nodes").groupBy(F.col("node_id").alias("id")).agg(F.max("node_type").alias("node_type"), F.max(F.lower("entity_type")).alias("entity_type"))
    return retrieval.ranked(table(spark, sf_dir, "retrieval")).join(info, "id").select("query_id", "kind", "id", "node_type", F.coalesce("entity_type", F.lit("")).alias("entity_type"))


@query(
    f"""WITH {ADJ}, {SEEDS}, d AS (SELECT s.node AS seed, other AS node FROM seeds s JOIN adj a ON a.node = s.node WHERE other <> s.node), c AS (SELECT seed, count(*) AS n FROM d GROUP BY 1),
    h AS (SELECT DISTINCT d.seed, a.other AS node FROM d JOIN c USING (seed) JOIN adj a ON a.node = d.node WHERE n <= 5 AND a.other <> d.seed)
    SELECT seed, node, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT seed, node, 1 AS hop FROM d UNION ALL SELECT seed, node, 2 FROM h) GROUP BY 1, 2"""
)
def neighbor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each seed, and of seeds with at most five of them the next hop too."""
    near = graph.adjacency(table(spark, sf_dir, "edges")).select("node", "other")
    direct = seeds(spark, sf_dir).join(near, "node").filter("node <> other").select(F.col("node").alias("seed"), F.col("other").alias("node"))
    few = direct.groupBy("seed").agg(F.count("*").alias("n")).filter("n <= 5").select("seed")
    second = direct.join(few, "seed", "left_semi").join(near, "node").select("seed", F.col("other").alias("node")).filter("seed <> node").distinct()
    both = direct.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
    return both.groupBy("seed", "node").agg(F.min("hop").alias("hop"))


@query("SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS number FROM (SELECT DISTINCT node_id FROM nodes)")
def graph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_index(table(spark, sf_dir, "nodes").select("node_id").distinct(), "node_id", name="number")


@query(
    f"""WITH {DEG}, mem AS (SELECT DISTINCT community_id, {KEY.format("m")} AS member FROM (SELECT community_id, unnest(members) AS m FROM communities)),
    r AS (SELECT community_id, node, degree, row_number() OVER (PARTITION BY community_id ORDER BY degree DESC, node) AS place FROM mem JOIN deg ON lower(node) = member) SELECT * FROM r WHERE place <= 10"""
)
def community_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table a community report is written from: its ten nodes of greatest degree."""
    members = table(spark, sf_dir, "communities").select("community_id", F.explode("members").alias("m")).select("community_id", id_key(F.col("m")).alias("member")).filter("member is not null").distinct()
    degree = graph.node_degree(table(spark, sf_dir, "edges")).withColumn("member", F.lower("node"))
    order = Window.partitionBy("community_id").orderBy(F.desc("degree"), "node")
    return members.join(degree, "member").withColumn("place", F.row_number().over(order)).filter("place <= 10").select("community_id", "node", "degree", "place")


@query(f"WITH {RELATIONS}, src AS (SELECT src, dst, unnest(source_ids) AS chunk FROM edges) SELECT query_id, chunk, min(place) AS first_place FROM o JOIN (SELECT DISTINCT * FROM src) USING (src, dst) WHERE used <= 60 AND chunk IS NOT NULL GROUP BY 1, 2")
def chunks_from_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "edges")
    placed = retrieval.relations_of_seeds(table(spark, sf_dir, "retrieval"), edges, graph.edge_degree(edges), merge.edge_text(edges), 60)
    sources = edges.select("src", "dst", F.explode("source_ids").alias("chunk")).filter("chunk is not null").distinct()
    return placed.join(sources, ["src", "dst"]).groupBy("query_id", "chunk").agg(F.min("place").alias("first_place"))


@query(f"WITH {RELATIONS} SELECT query_id, node, max(degree) AS degree FROM (SELECT query_id, unnest([src, dst]) AS node FROM o WHERE used <= 60) JOIN deg USING (node) GROUP BY 1, 2")
def entities_from_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of a query's relations, with their degree; all are kept."""
    edges = table(spark, sf_dir, "edges")
    placed = retrieval.relations_of_seeds(table(spark, sf_dir, "retrieval"), edges, graph.edge_degree(edges), merge.edge_text(edges), 60)
    ends = placed.select("query_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.join(graph.node_degree(edges), "node").select("query_id", "node", "degree")


@query(f"WITH {RANKED} SELECT query_id, kind, id, round(greatest(0.1, 1 - CASE WHEN kind = 'chunk' THEN 0.15 ELSE 0.1 END * (pos - 1)), 6) AS score FROM rk WHERE (kind = 'entity' AND pos <= 8 OR kind = 'chunk' AND pos <= 5) AND greatest(0.1, 1 - CASE WHEN kind = 'chunk' THEN 0.15 ELSE 0.1 END * (pos - 1)) >= 0.3")
def match_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds by position: scores fall by a tenth for entities and 0.15 for chunks; at least 0.3."""
    rows = retrieval.ranked(table(spark, sf_dir, "retrieval")).filter("kind = 'entity' and pos <= 8 or kind = 'chunk' and pos <= 5")
    score = F.greatest(F.lit(0.1), 1 - F.when(F.col("kind") == "chunk", 0.15).otherwise(0.1) * (F.col("pos") - 1))
    return rows.select("query_id", "kind", "id", F.round(score, 6).alias("score")).filter("score >= 0.3")


@query(f"WITH {RANKED}, b AS (SELECT id, max(score) AS s FROM rk WHERE kind = 'entity' AND score > 0 GROUP BY 1) SELECT id, round(s / sum(s) OVER (), 9) AS mass FROM b")
def reset_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reset vector of similarity: each entity's best score over all queries, to sum one."""
    best = retrieval.ranked(table(spark, sf_dir, "retrieval")).filter("kind = 'entity' and score > 0").groupBy("id").agg(F.max("score").alias("s"))
    return best.crossJoin(F.broadcast(best.agg(F.sum("s").alias("total")))).select("id", F.round(F.col("s") / F.col("total"), 9).alias("mass"))


@query("SELECT community_id, md5('# ' || community_id || chr(10) || chr(10) || coalesce(max(summary), '') || chr(10)) AS report FROM communities GROUP BY 1")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "communities").groupBy("community_id").agg(F.coalesce(F.max("summary"), F.lit("")).alias("s"))
    return rows.select("community_id", F.md5(F.concat(F.lit("# "), "community_id", F.lit("\n\n"), "s", F.lit("\n"))).alias("report"))


@query(f"WITH {GOLD} SELECT id, round(avg(CAST(contains(p, g) AS INTEGER)), 6) AS str_em, CAST(min(CAST(contains(p, g) AS INTEGER)) AS INTEGER) AS hit FROM gold GROUP BY 1")
def string_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of gold answers that the output contains, and whether it contains all."""
    rows = table(spark, sf_dir, "results").select("id", tx.normal_answer(F.col("output")).alias("p"), F.explode(evaluate.golds(F.col("answer"))).alias("g")).distinct()
    inside = F.contains("p", "g").cast("int")
    return rows.groupBy("id").agg(F.round(F.avg(inside), 6).alias("str_em"), F.min(inside).alias("hit"))


@query("SELECT node_id, max(node_type) AS node_type, count(*) AS states, max(updated_at) AS newest FROM (SELECT DISTINCT * FROM node_state) GROUP BY 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "node_state").distinct().groupBy("node_id").agg(F.max("node_type").alias("node_type"), F.count("*").alias("states"), F.max("updated_at").alias("newest"))


@query()
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.connected_components(table(spark, sf_dir, "edges"))
    top = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return found.join(F.broadcast(top.select("component")), "component", "left_semi").select("node")


@query()
def lsh_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of clusters: signatures, packed buckets, means, and again."""

    def cluster(rows: DataFrame) -> DataFrame:
        signed = rows.withColumn("bucket", vx.signature(F.col("embedding"), 8, 64, vx.plane_signs(8, 64)))
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
        packed = incremental.pack_buckets(signed, 5, 50)
        upto = F.sum("part_rows").over(Window.partitionBy("bucket").orderBy("cluster").rowsBetween(Window.unboundedPreceding, 0))
        ranges = packed.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("part_rows"))
        numbered = signed.select("id", "bucket", place.alias("n"))
        return numbered.join(ranges, "bucket").filter((F.col("n") > F.col("from")) & (F.col("n") <= F.col("upto"))).select("id", "cluster")

    rows = table(spark, sf_dir, "embeddings").filter("size(embedding) = 64").select(F.col("vec_id").alias("id"), "embedding")
    return trees.build_layers(rows, cluster, layers=3, least=5)


@query()
def refreshed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of the affected nodes only, from their neighbours' present values."""
    own = table(spark, sf_dir, "vectors").filter("space = 'node' and size(embedding) = 64").groupBy(F.col("owner_id").alias("node")).agg(F.first("embedding").alias("embedding"))
    own = own.withColumn("embedding", F.col("embedding").cast("array<double>"))
    affected = table(spark, sf_dir, "node_state").groupBy("node_id").agg(F.max_by("is_affected", "updated_at").alias("a")).filter("a").select(F.col("node_id").alias("node"))
    near = table(spark, sf_dir, "edges").select("src", "dst", "weight")
    touched = near.join(affected.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(near.join(affected.withColumnRenamed("node", "dst"), "dst", "left_semi")).distinct()
    known = touched.join(own.select(F.col("node").alias("src")), "src", "left_semi").join(own.select(F.col("node").alias("dst")), "dst", "left_semi")
    return graph.propagate_embeddings(known, own, 1).join(affected, "node", "left_semi")
