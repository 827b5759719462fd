"""Queries over nodes, edges and graph algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, merge
from graphloom.plans.registry import query
from graphloom.session import table

E = "e AS (SELECT DISTINCT * FROM edges)"
ADJ = """adj AS (SELECT node, other, max(weight) AS weight FROM (SELECT src AS node, dst AS other, coalesce(weight, 0) AS weight FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL
  UNION ALL SELECT dst, src, coalesce(weight, 0) FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL) GROUP BY 1, 2)"""
DEG = f"{ADJ}, deg AS (SELECT node, CAST(sum(CASE WHEN node = other THEN 2 ELSE 1 END) AS BIGINT) AS degree FROM adj GROUP BY 1)"
MENT = "ment AS (SELECT DISTINCT node_id AS entity, chunk FROM (SELECT node_id, unnest(source_ids) AS chunk FROM nodes WHERE node_type = 'entity') WHERE chunk IS NOT NULL)"
SEEDS = "seeds AS (SELECT DISTINCT id AS node FROM retrieval WHERE kind = 'entity' AND rank = 1)"
TRIM = "regexp_replace({}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "retrieval").filter("kind = 'entity' and rank = 1").select(F.col("id").alias("node")).distinct()


@query(
    f"""WITH n AS (SELECT *, lower({TRIM.format("entity_name")}) AS name FROM (SELECT DISTINCT * FROM nodes) WHERE node_type = 'entity' AND entity_name IS NOT NULL),
    g AS (SELECT * FROM n WHERE name <> ''),
    kinds AS (SELECT name, lower(entity_type) AS kind, count(*) AS c FROM g WHERE coalesce(entity_type, '') <> '' GROUP BY 1, 2),
    kind AS (SELECT name, kind FROM kinds QUALIFY row_number() OVER (PARTITION BY name ORDER BY c DESC, kind) = 1),
    src AS (SELECT name, count(DISTINCT s) AS n_sources, min(s) AS first_source FROM (SELECT name, unnest(source_ids) AS s FROM g) WHERE s IS NOT NULL GROUP BY 1),
    m AS (SELECT name, coalesce(string_agg(DISTINCT CASE WHEN description <> '' THEN description END, '<SEP>' ORDER BY CASE WHEN description <> '' THEN description END), '') AS description, count(*) AS n FROM g GROUP BY 1)
    SELECT m.name, coalesce(kind, '') AS entity_type, description, coalesce(n_sources, 0) AS n_sources, first_source, n FROM m LEFT JOIN kind USING (name) LEFT JOIN src USING (name)"""
)
def merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_nodes(table(spark, sf_dir, "nodes"))


def _union_sql(column: str, extra: str = "") -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(flatten(list({column})), lambda x: x IS NOT NULL {extra}))), '<SEP>')"


@query(
    f"""WITH e AS (SELECT DISTINCT *, least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL)
    SELECT a, b, round(sum(coalesce(weight, 0.0)), 6) AS weight, {_union_sql("coalesce(relation_names, [])", "AND x <> ''")} AS relations, {_union_sql("coalesce(keywords, [])")} AS keywords,
    CAST(len(list_distinct(list_filter(flatten(list(coalesce(source_ids, []))), lambda x: x IS NOT NULL))) AS INTEGER) AS n_sources, count(*) AS n FROM e GROUP BY 1, 2"""
)
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_edges(table(spark, sf_dir, "edges"))


@query(
    f"""WITH {E}, ends AS (SELECT src AS node_id, source_ids FROM e UNION ALL SELECT dst, source_ids FROM e),
    lost AS (SELECT * FROM ends WHERE node_id IS NOT NULL AND node_id NOT IN (SELECT node_id FROM nodes WHERE node_id IS NOT NULL)),
    s AS (SELECT node_id, unnest(CASE WHEN len(source_ids) > 0 THEN source_ids ELSE [NULL] END) AS s FROM lost)
    SELECT node_id, count(DISTINCT s) AS n_sources FROM s GROUP BY 1"""
)
def missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.missing_endpoints(table(spark, sf_dir, "edges"), table(spark, sf_dir, "nodes"))


@query(f"WITH {MENT} SELECT entity AS src, chunk AS dst, 'BELONGS_TO' AS relation, 1.0::DOUBLE AS weight FROM ment UNION ALL SELECT a.chunk, b.chunk, 'SHARED_ENTITY', count(*)::DOUBLE FROM ment a JOIN ment b ON a.entity = b.entity AND a.chunk < b.chunk GROUP BY 1, 2 HAVING count(*) >= 2")
def hybrid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.hybrid_edges(table(spark, sf_dir, "nodes"))


@query(f"WITH {MENT} SELECT a.chunk AS a, b.chunk AS b, CAST(count(*) AS INTEGER) AS shared FROM ment a JOIN ment b ON a.entity = b.entity AND a.chunk < b.chunk GROUP BY 1, 2 HAVING count(*) >= 2")
def shared_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.shared_entity_pairs(merge.entity_chunks(table(spark, sf_dir, "nodes")))


@query(f"WITH {MENT} SELECT entity, chunk FROM ment")
def entity_chunk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.entity_chunks(table(spark, sf_dir, "nodes"))


@query(
    f"""WITH r AS (SELECT DISTINCT chunk_id, lower({TRIM.format("title")}) AS title FROM chunks WHERE chunk_id IS NOT NULL), s AS (SELECT title, min(chunk_id) AS title_class, count(*) AS n FROM r WHERE title <> '' GROUP BY 1)
    SELECT chunk_id, min(title_class) AS title_class, CAST(sum(n - 1) AS BIGINT) AS links FROM r JOIN s USING (title) GROUP BY 1"""
)
def passage_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.title_classes(table(spark, sf_dir, "chunks"))


@query("SELECT src, dst, coalesce(weight, 1.0) AS weight, CASE WHEN len(relation_names) > 0 THEN lower(relation_names[1]) ELSE '' END AS kind FROM (SELECT DISTINCT * FROM edges)")
def homogeneous_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.size("relation_names") > 0, F.lower(F.col("relation_names")[0])).otherwise("")
    return table(spark, sf_dir, "edges").distinct().select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"), name.alias("kind"))


@query("SELECT DISTINCT unnest([src, dst]) AS node_id, src || '->' || dst AS edge_id FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL")
def e2r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.incidence(table(spark, sf_dir, "edges"))


@query("SELECT edge_id, chunk_id FROM (SELECT DISTINCT src || '->' || dst AS edge_id, unnest(source_ids) AS chunk_id FROM edges) WHERE chunk_id IN (SELECT chunk_id FROM chunks)")
def r2c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.relation_chunks(table(spark, sf_dir, "edges"), table(spark, sf_dir, "chunks"))


@query(f"SELECT node_id, concat_ws(': ', nullif({TRIM.format('entity_name')}, ''), nullif({TRIM.format('entity_type')}, ''), nullif({TRIM.format('description')}, '')) AS text FROM (SELECT DISTINCT * FROM nodes)")
def node_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.node_text(table(spark, sf_dir, "nodes"))


@query(
    f"""SELECT src, dst, CASE WHEN names <> '' THEN names ELSE {TRIM.format("concat_ws(' ', words, src, dst, description)")} END AS text FROM (SELECT *, array_to_string(list_filter(coalesce(relation_names, []), lambda x: x <> ''), ', ') AS names,
    array_to_string(coalesce(keywords, []), ', ') AS words FROM (SELECT DISTINCT * FROM edges))"""
)
def edge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.edge_text(table(spark, sf_dir, "edges"))


@query(
    f"""WITH {E}, r AS (SELECT DISTINCT unnest(source_ids) AS source, src, dst, concat_ws(' ', src, coalesce(list_filter(relation_names, lambda x: x <> '')[1], 'related'), dst) AS t FROM e)
    SELECT source, count(*) AS n, md5(string_agg(t, '; ' ORDER BY src, dst, t)) AS text FROM r GROUP BY 1"""
)
def subgraph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.subgraph_text(table(spark, sf_dir, "edges")).withColumn("text", F.md5("text"))


@query(f"WITH {DEG} SELECT node, degree FROM deg")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_degree(table(spark, sf_dir, "edges"))


@query(f"WITH {DEG} SELECT p.src, p.dst, coalesce(a.degree, 0) + coalesce(b.degree, 0) AS degree FROM (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL) p LEFT JOIN deg a ON a.node = p.src LEFT JOIN deg b ON b.node = p.dst")
def edge_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_degree(table(spark, sf_dir, "edges"))


@query(f"WITH {ADJ} SELECT node, other, weight FROM adj")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(table(spark, sf_dir, "edges"))


@query(
    f"""WITH {ADJ}, {SEEDS}, h1 AS (SELECT DISTINCT other AS node FROM adj WHERE node IN (FROM seeds) AND other NOT IN (FROM seeds)),
    h2 AS (SELECT DISTINCT other AS node FROM adj WHERE node IN (FROM h1) AND other NOT IN (FROM seeds) AND other NOT IN (FROM h1)) SELECT node, CAST(2 AS INTEGER) AS hop FROM h2"""
)
def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.k_hop(table(spark, sf_dir, "edges"), seeds(spark, sf_dir), 2)


@query("WITH k AS (SELECT DISTINCT id FROM retrieval WHERE kind = 'entity') SELECT DISTINCT src, dst, weight FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "retrieval").filter("kind = 'entity'").select(F.col("id").alias("node"))
    return graph.induced_subgraph(table(spark, sf_dir, "edges"), keep).select("src", "dst", "weight").distinct()


_STEP = """r{i} AS (SELECT b.node, b.reset * 0.5 + 0.5 * (coalesce(s.got, 0) + l.lost * b.reset) AS score FROM base b
  LEFT JOIN (SELECT m.other AS node, sum(r.score * m.p) AS got FROM moves m JOIN r{j} r ON r.node = m.node GROUP BY 1) s ON s.node = b.node,
  (SELECT coalesce(sum(score), 0) AS lost FROM r{j} WHERE node NOT IN (SELECT node FROM outs)) l)"""


def _pagerank_sql(rounds: int) -> str:
    steps = ", ".join(_STEP.format(i=i, j=i - 1) for i in range(1, rounds + 1))
    return f"""{ADJ}, {SEEDS}, ways AS (SELECT * FROM adj WHERE weight > 0), outs AS (SELECT node, sum(weight) AS o FROM ways GROUP BY 1),
    moves AS (SELECT node, other, weight / o AS p FROM ways JOIN outs USING (node)), every AS (SELECT node FROM ways UNION SELECT node FROM seeds),
    base AS (SELECT e.node, CASE WHEN s.node IS NULL THEN 0.0 ELSE 1.0 / (SELECT count(*) FROM seeds) END AS reset FROM every e LEFT JOIN seeds s USING (node)),
    r0 AS (SELECT node, reset AS score FROM base), {steps}"""


@query(f"WITH {_pagerank_sql(3)} SELECT node, round(score, 9) AS score FROM r3")
def ppr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = graph.personalized_pagerank(table(spark, sf_dir, "edges"), seeds(spark, sf_dir).withColumn("mass", F.lit(1.0)), rounds=3)
    return rank.select("node", F.round("score", 9).alias("score"))


@query(f"WITH {MENT} SELECT n.node_id, coalesce(1.0 / nullif(c.k, 0), 1.0) AS mass FROM (SELECT DISTINCT node_id FROM nodes WHERE node_type = 'entity') n LEFT JOIN (SELECT entity, count(*) AS k FROM ment GROUP BY 1) c ON c.entity = n.node_id")
def reset_node_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes")
    counts = merge.entity_chunks(nodes).groupBy(F.col("entity").alias("node_id")).agg(F.count("*").alias("k"))
    ids = nodes.filter("node_type = 'entity'").select("node_id").distinct()
    return ids.join(counts, "node_id", "left").select("node_id", F.coalesce(F.try_divide(F.lit(1.0), "k"), F.lit(1.0)).alias("mass"))


@query(
    f"""WITH {_pagerank_sql(3)}, ed AS (SELECT DISTINCT unnest([src, dst]) AS node, src || '->' || dst AS edge_id FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
    es AS (SELECT edge_id, sum(score) AS s FROM ed JOIN r3 USING (node) GROUP BY 1), rc AS (SELECT DISTINCT src || '->' || dst AS edge_id, unnest(source_ids) AS chunk_id FROM edges),
    cs AS (SELECT chunk_id, sum(s) AS s FROM rc JOIN es USING (edge_id) WHERE chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY 1)
    SELECT chunk_id, round(coalesce((s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0), 0), 6) AS score FROM cs"""
)
def chunk_ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "edges")
    rank = graph.personalized_pagerank(edges, seeds(spark, sf_dir).withColumn("mass", F.lit(1.0)), rounds=3)
    return _chunk_scores(spark, sf_dir, rank)


def _chunk_scores(spark: SparkSession, sf_dir: str, rank: DataFrame) -> DataFrame:
    edges = table(spark, sf_dir, "edges")
    edge = merge.incidence(edges).join(rank.withColumnRenamed("node", "node_id"), "node_id").groupBy("edge_id").agg(F.sum("score").alias("s"))
    chunk = merge.relation_chunks(edges, table(spark, sf_dir, "chunks")).join(edge, "edge_id").groupBy("chunk_id").agg(F.sum("s").alias("s"))
    ends = chunk.agg(F.min("s").alias("low"), F.max("s").alias("high"))
    scaled = F.coalesce(F.try_divide(F.col("s") - F.col("low"), F.nullif(F.col("high") - F.col("low"), F.lit(0.0))), F.lit(0.0))
    return chunk.crossJoin(F.broadcast(ends)).select("chunk_id", F.round(scaled, 6).alias("score"))


@query()
def ppr_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ppr_scores, whose SQL has three steps, but by the default rounds: the error left is 0.5^20 of the mass."""
    rank = graph.personalized_pagerank(table(spark, sf_dir, "edges"), seeds(spark, sf_dir).withColumn("mass", F.lit(1.0)))
    return rank.select("node", F.round("score", 9).alias("score"))


@query()
def chunk_ppr_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As chunk_ppr, from the ranks of ppr_converged before they are rounded."""
    rank = graph.personalized_pagerank(table(spark, sf_dir, "edges"), seeds(spark, sf_dir).withColumn("mass", F.lit(1.0)))
    return _chunk_scores(spark, sf_dir, rank)


@query()
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.connected_components(table(spark, sf_dir, "edges"))
    return found.groupBy("component").agg(F.count("*").alias("n"))


@query()
def propagated_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "vectors").filter("space = 'node' and size(embedding) = 64").groupBy(F.col("owner_id").alias("node")).agg(F.first("embedding").alias("embedding"))
    edges = table(spark, sf_dir, "edges").join(own.select(F.col("node").alias("src")), "src", "left_semi").join(own.select(F.col("node").alias("dst")), "dst", "left_semi")
    return graph.propagate_embeddings(edges, own.withColumn("embedding", F.col("embedding").cast("array<double>")), 2)


@query()
def label_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_communities(table(spark, sf_dir, "edges"))


@query()
def seed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bounded_paths(table(spark, sf_dir, "edges"), seeds(spark, sf_dir), 5)


@query(
    "SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, count(*) AS n, round(sum(l_quantity), 2) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"
)
def customer_part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("weight"))
