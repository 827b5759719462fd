"""Graphs from chunks: one-step and two-step builders, model literals, packed tables, and community contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import extraction
from graphloom.operators.hierarchy import id_key

#: How a model writes nodes and relationships.
NODE = r"Node\(id='(.*?)', type='(.*?)'\)"
RELATION = r"Relationship\(subj=Node\(id='(.*?)', type='(.*?)'\), obj=Node\(id='(.*?)', type='(.*?)'\), type='(.*?)'\)"


def _groups(text: Column, pattern: str, count: int) -> Column:
    every = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(f"g{i}") for i in range(count)]
    return F.explode(F.arrays_zip(*every))


def parse_literals(replies: DataFrame, key: str = "chunk_id", column: str = "reply") -> tuple[DataFrame, DataFrame]:
    """((key, node, type), (key, src, dst, relation)) of literals; a relation stays only if both ends were given as nodes."""
    rows = replies.select(key, F.coalesce(column, F.lit("")).alias("t"))
    alone = F.regexp_replace("t", RELATION, "")
    nodes = rows.select(key, _groups(alone, NODE, 2).alias("g")).select(key, F.col("g.g0").alias("node"), F.col("g.g1").alias("type")).filter("node <> ''").distinct()
    links = rows.select(key, _groups(F.col("t"), RELATION, 5).alias("g")).select(key, F.col("g.g0").alias("src"), F.col("g.g2").alias("dst"), F.col("g.g4").alias("relation")).distinct()
    known = nodes.select(key, "node").distinct()
    for end in ("src", "dst"):
        links = links.join(known.withColumnRenamed("node", end), [key, end], "left_semi")
    return nodes, links.select(key, "src", "dst", "relation")


def merge_triples(triples: DataFrame) -> DataFrame:
    """(a, b, weight, relations, n_sources) of (chunk_id, subject, predicate, object[, weight]) by unordered pair."""
    weight = F.col("weight") if "weight" in triples.columns else F.lit(1.0)
    rows = triples.withColumns({"a": F.least("subject", "object"), "b": F.greatest("subject", "object"), "w": weight})
    return rows.groupBy("a", "b").agg(
        F.round(F.sum("w"), 6).alias("weight"), F.array_join(F.array_sort(F.collect_set("predicate")), "<SEP>").alias("relations"), F.count_distinct("chunk_id").alias("n_sources")
    )


def entity_relation_graph(chunks: DataFrame, provider: extraction.Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of chunks: entities and triples are extracted, then merged by name and by pair."""
    nodes = extraction.mentions(chunks, provider).groupBy("entity").agg(F.count_distinct("chunk_id").alias("n_sources"))
    return nodes, merge_triples(extraction.triples(chunks))


def rich_graph(records: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of delimited records (key, record) with types, descriptions, keywords and weights."""
    text = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), "<SEP>")
    nodes = extraction.parse_entities(records).groupBy("entity_name").agg(F.min("entity_type").alias("entity_type"), text("description").alias("description"), F.count("*").alias("n"))
    links = extraction.parse_relations(records).withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    edges = links.groupBy("a", "b").agg(F.round(F.sum("weight"), 6).alias("weight"), text("keywords").alias("keywords"), F.count("*").alias("n"))
    return nodes, edges


def unpack(rows: DataFrame, key: list[str], column: str, separator: str = "<SEP>") -> DataFrame:
    """(key, value): the parts of a packed text, blanks dropped; a null text has none."""
    import re

    parts = F.filter(F.split(F.coalesce(column, F.lit("")), re.escape(separator)), lambda p: p != "")
    return rows.select(*key, F.explode(parts).alias("value"))


def members(communities: DataFrame) -> DataFrame:
    """(community_id, level, key): distinct members, ids as they are compared."""
    return communities.filter("community_id is not null").select("community_id", F.explode("members").alias("m"), "level").select("community_id", "level", id_key(F.col("m")).alias("key")).filter("key is not null").distinct()


def clusters_of_nodes(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """(node_id, clusters): the communities that list a node, as 'level:community', sorted; the level is the community's greatest."""
    level = communities.filter("community_id is not null").groupBy("community_id").agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"))
    listed = members(communities).select("community_id", "key").distinct().join(level, "community_id")
    ids = nodes.filter("node_id is not null").select("node_id", id_key(F.col("node_id")).alias("key")).distinct()
    said = F.concat_ws(":", F.col("level").cast("string"), "community_id")
    return ids.join(listed, "key").groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set(said)), ",").alias("clusters"))


def community_contents(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community_id, chunks, entities, relations): members by kind, and edges with both ends inside."""
    kinds = nodes.filter("node_id is not null").select("node_id", id_key(F.col("node_id")).alias("key"), "node_type").distinct()
    inside = members(communities).select("community_id", "key").distinct().join(kinds, "key")
    counts = inside.groupBy("community_id").agg(
        F.count_distinct(F.when(F.col("node_type") == "chunk", F.col("node_id"))).alias("chunks"), F.count_distinct(F.when(F.col("node_type") == "entity", F.col("node_id"))).alias("entities")
    )
    ends = inside.filter("node_type = 'entity'").select("community_id", "node_id").distinct()
    links = edges.filter("src is not null and dst is not null").select("src", "dst").distinct()
    own = links.join(ends.withColumnRenamed("node_id", "src"), "src").join(ends.withColumnRenamed("node_id", "dst"), ["community_id", "dst"])
    return counts.join(own.groupBy("community_id").agg(F.count("*").alias("relations")), "community_id", "left").select("community_id", "chunks", "entities", F.coalesce("relations", F.lit(0)).alias("relations"))


def state_of(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """(node_id, level, parent): the state a graph and its communities imply; communities lie one level above their own."""
    listed = members(communities).groupBy("key").agg(F.min("community_id").alias("parent"))
    own = nodes.filter("node_id is not null and node_type <> 'community'").select("node_id", F.lit(0).alias("level")).distinct()
    above = communities.filter("community_id is not null").groupBy(F.col("community_id").alias("node_id")).agg((F.coalesce(F.max("level"), F.lit(0)) + 1).alias("level"))
    return own.unionByName(above).withColumn("key", id_key(F.col("node_id"))).join(listed, "key", "left").select("node_id", "level", "parent")
