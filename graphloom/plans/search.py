"""Queries that start from texts: embeddings, typed search and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import embed, retrieval
from graphloom.plans.registry import query
from graphloom.session import cut_lineage, ensure_checkpoint_dir, table

TEXTS = """tx AS (SELECT id, kind, max(text) AS text FROM (
    SELECT node_id AS id, 'entity' AS kind, concat_ws('. ', entity_name, nullif(description, '')) AS text FROM nodes WHERE node_type = 'entity' AND node_id IS NOT NULL
    UNION ALL SELECT 'CHUNK_' || chunk_id, 'chunk', coalesce(content, '') FROM chunks WHERE chunk_id IS NOT NULL
    UNION ALL SELECT community_id, 'community', coalesce(summary, '') FROM communities WHERE community_id IS NOT NULL) GROUP BY 1, 2)"""
ASK = "ask AS (SELECT CAST(id AS VARCHAR) AS id, 'ask' AS kind, max(question) AS text FROM results WHERE id % 50 = 0 GROUP BY 1)"


def embedded(name: str, source: str) -> str:
    """SQL of the offline embedding: (id, kind, d, v) of every column that is not zero."""
    return f"""{name}w AS (SELECT id, kind, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{2,}}')) AS w FROM {source}),
    {name}c AS (SELECT id, kind, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 256 AS d, sum(CASE WHEN substr(md5(w), 5, 1) IN ('0','2','4','6','8','a','c','e') THEN 1.0 ELSE -1.0 END) AS c FROM {name}w GROUP BY 1, 2, 3),
    {name} AS (SELECT id, kind, d, c / sqrt(sum(c * c) OVER (PARTITION BY id, kind)) AS v FROM {name}c WHERE c <> 0)"""


def near(name: str, asks: str, rows: str, where: str = "true") -> str:
    """SQL of scores of every question with every row, and the positions by kind."""
    return f"""{name}d AS (SELECT a.id AS q, r.id, r.kind, sum(a.v * r.v) AS s FROM {asks} a JOIN {rows} r USING (d) GROUP BY 1, 2, 3),
    {name} AS (SELECT CAST(a.id AS BIGINT) AS query_id, r.kind, r.id, round(coalesce(s, 0), 9) AS score, row_number() OVER (PARTITION BY a.id, r.kind ORDER BY round(coalesce(s, 0), 9) DESC, r.id) AS pos
      FROM (SELECT DISTINCT id FROM {asks}) a CROSS JOIN (SELECT DISTINCT id, kind FROM {rows}) r LEFT JOIN {name}d ON {name}d.q = a.id AND {name}d.id = r.id AND {name}d.kind = r.kind WHERE {where})"""


SEARCH = f"{TEXTS}, {ASK}, {embedded('e', 'tx')}, {embedded('a', 'ask')}, {near('nn', 'a', 'e')}"
FLAT = """po AS (SELECT * FROM nn WHERE kind = 'entity' AND pos <= 25 OR kind = 'chunk' AND pos <= 5 OR kind = 'community' AND pos <= 1),
    mx AS (SELECT query_id, kind, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, id) AS place FROM po WHERE kind <> 'entity'),
    fl AS (SELECT query_id, kind, id, place FROM mx WHERE place <= 5 UNION ALL SELECT query_id, kind, id, pos FROM po WHERE kind = 'entity' AND pos <= 5)"""
_KEY = "lower(trim({}, ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || chr(160) || chr(8203) || chr(65279)))"
RELATED = f"""mb AS (SELECT DISTINCT f.query_id, t.id AS node FROM fl f JOIN (SELECT community_id, unnest(members) AS m FROM communities) c ON c.community_id = f.id JOIN tx t ON t.kind = 'entity' AND {_KEY.format('t.id')} = {_KEY.format('c.m')} WHERE f.kind = 'community'),
    pl AS (SELECT query_id, id AS node FROM po WHERE kind = 'entity' AND pos <= 15 UNION SELECT query_id, node FROM mb),
    ed AS (SELECT src || '|' || dst AS id, 'relation' AS kind, src, max(concat_ws(' ', array_to_string(relation_names, ' '), description)) AS text FROM edges WHERE src IN (SELECT node FROM pl) AND dst IS NOT NULL AND dst NOT IN (SELECT id FROM tx WHERE kind = 'chunk') GROUP BY src, dst),
    {embedded('r', 'ed')},
    rs AS (SELECT p.query_id, x.id, round(coalesce(s, 0), 9) AS score FROM pl p JOIN (SELECT DISTINCT r.id, src FROM r JOIN ed USING (id)) x ON x.src = p.node
      JOIN (SELECT DISTINCT id FROM a) q ON CAST(q.id AS BIGINT) = p.query_id LEFT JOIN (SELECT a.id AS q, r.id, sum(a.v * r.v) AS s FROM a JOIN r USING (d) GROUP BY 1, 2) y ON y.q = q.id AND y.id = x.id),
    rl AS (SELECT query_id, 'relation' AS kind, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM (SELECT DISTINCT * FROM rs))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, embedding) of every question whose id is divisible by 50."""
    rows = table(spark, sf_dir, "results").filter("id % 50 = 0").groupBy(F.col("id").alias("query_id")).agg(F.max("question").alias("text"))
    return embed.embed_texts(rows)


def node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, embedding) of chunks, entities and communities."""
    return embed.embed_texts(embed.node_texts(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "communities")))


def searched(spark: SparkSession, sf_dir: str, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits of every kind, index, questions)."""
    index, asked = node_index(spark, sf_dir), questions(spark, sf_dir)
    return cut_lineage(embed.typed_knn(index, asked, {"chunk": k, "entity": 5 * k, "community": k})), index, asked


@query(f"WITH {TEXTS}, {embedded('e', 'tx')} SELECT id, kind, count(*) AS columns, round(max(abs(v)), 6) AS most FROM e GROUP BY 1, 2")
def text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in use and the greatest weight of every text's embedding."""
    used = F.filter("embedding", lambda v: v != 0)
    return node_index(spark, sf_dir).select("id", "kind", F.size(used).cast("bigint").alias("columns"), F.round(F.array_max(F.transform(used, F.abs)), 6).alias("most"))


@query(f"WITH {TEXTS}, {embedded('e', 'tx')} SELECT kind, count(DISTINCT id) AS n, count(*) AS columns FROM e GROUP BY 1")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners and columns in use by kind, of an index written, refreshed and read again."""
    import uuid

    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"
    whole = node_index(spark, sf_dir)
    embed.save_index(whole.filter("kind <> 'community'"), f"{place}/old")
    embed.refresh_index(spark, f"{place}/old", whole.filter("kind in ('community', 'chunk')"), f"{place}/new")
    return embed.load_index(spark, f"{place}/new").groupBy("kind").agg(F.count_distinct("id").alias("n"), F.sum(F.size(F.filter("embedding", lambda v: v != 0))).alias("columns"))


@query(f"WITH {SEARCH} SELECT query_id, kind, id, pos AS rank FROM nn WHERE kind = 'entity' AND pos <= 25 OR kind <> 'entity' AND pos <= 5")
def typed_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark, sf_dir)[0].select("query_id", "kind", "id", "rank")


def flat_search(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """(query_id, kind, id, place): nearest chunks and communities under their quotas, entities, and relations of
    the entity pool and of the chosen communities' members."""
    hits, index, asked = searched(spark, sf_dir, k)
    flat = cut_lineage(retrieval.hierarchical_flat_search(hits, k))
    members = embed.member_entities(flat, table(spark, sf_dir, "communities"), index.filter("kind = 'entity'"))
    pool = hits.filter((F.col("kind") == "entity") & (F.col("rank") <= 3 * k)).select("query_id", F.col("id").alias("node")).unionByName(members).distinct()
    chunk_ids = table(spark, sf_dir, "chunks").select(F.concat(F.lit("CHUNK_"), "chunk_id").alias("id"))
    relations = embed.related_edges(cut_lineage(pool), table(spark, sf_dir, "edges"), asked, chunk_ids, k)
    return flat.unionByName(relations.select("query_id", F.lit("relation").alias("kind"), F.concat_ws("|", "src", "dst").alias("id"), "place"))


@query(f"WITH {SEARCH}, {FLAT}, {RELATED} SELECT query_id, kind, id, CAST(place AS INTEGER) AS place FROM fl UNION ALL SELECT query_id, kind, id, CAST(place AS INTEGER) FROM rl WHERE place <= 5")
def flat_search_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_search(spark, sf_dir)


@query(f"WITH {SEARCH} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM nn WHERE kind IN ('chunk', 'community') QUALIFY place <= 8")
def collapsed_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest nodes of the whole tree, leaves and summaries alike."""
    index = node_index(spark, sf_dir).filter("kind in ('chunk', 'community')").withColumn("kind", F.lit("tree"))
    return embed.typed_knn(index, questions(spark, sf_dir), {"tree": 8}).select("query_id", "id", F.col("rank").alias("place"))


_EDGE = "ed AS (SELECT src || '|' || dst AS id, 'relation' AS kind, max(concat_ws(' ', array_to_string(relation_names, ' '), description)) AS text FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst)"
RELATIONS = f"{_EDGE}, {ASK}, {embedded('r', 'ed')}, {embedded('a', 'ask')}, {near('nr', 'a', 'r')}"


def nearest_relations(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """(query_id, kind, id, rank, score): edges nearest to each question; id is src|dst."""
    text = F.concat_ws(" ", F.array_join("relation_names", " "), "description")
    edges = table(spark, sf_dir, "edges").filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.max(text).alias("text"))
    index = embed.embed_texts(edges.select(F.concat_ws("|", "src", "dst").alias("id"), F.lit("relation").alias("kind"), "text"))
    return embed.typed_knn(index, questions(spark, sf_dir), {"relation": k})


@query(f"WITH {RELATIONS} SELECT query_id, id, pos AS rank FROM nr WHERE pos <= 10")
def relation_vdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_relations(spark, sf_dir).select("query_id", "id", "rank")


@query(
    f"""WITH {RELATIONS}, hit AS (SELECT query_id, id, pos FROM nr WHERE pos <= 10), en AS (SELECT query_id, string_split(id, '|')[1] AS a, string_split(id, '|')[2] AS b, id, pos FROM hit),
    ents AS (SELECT query_id, node, min(pos) AS pos FROM (SELECT query_id, a AS node, pos FROM en UNION ALL SELECT query_id, b, pos FROM en) GROUP BY 1, 2),
    chs AS (SELECT query_id, chunk, min(pos) AS pos FROM (SELECT en.query_id, unnest(e.source_ids) AS chunk, en.pos FROM en JOIN edges e ON e.src = en.a AND e.dst = en.b) WHERE chunk IS NOT NULL GROUP BY 1, 2)
    SELECT query_id, 'relation' AS section, id, CAST(pos AS INTEGER) AS place FROM hit UNION ALL SELECT query_id, 'entity', node, CAST(pos AS INTEGER) FROM ents UNION ALL SELECT query_id, 'chunk', chunk, CAST(pos AS INTEGER) FROM chs"""
)
def strategy_global_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations nearest to the question, then their entities and their chunks, each by the first relation that names it."""
    hits = cut_lineage(nearest_relations(spark, sf_dir).select("query_id", "id", F.col("rank").alias("place")))
    ends = hits.select("query_id", F.split("id", "\\|").alias("e"), "place")
    entities = ends.select("query_id", F.explode("e").alias("id"), "place").groupBy("query_id", "id").agg(F.min("place").alias("place"))
    pairs = ends.select("query_id", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"), "place")
    chunks = table(spark, sf_dir, "edges").join(pairs, ["src", "dst"]).select("query_id", F.explode("source_ids").alias("id"), "place").filter("id is not null").groupBy("query_id", "id").agg(F.min("place").alias("place"))
    part = lambda frame, name: frame.select("query_id", F.lit(name).alias("section"), "id", "place")
    return part(hits, "relation").unionByName(part(entities, "entity")).unionByName(part(chunks, "chunk"))
