"""Building and merging the property graph: group-by aggregations over nodes and edges.

Repeated rows count once everywhere; null arrays are empty; the result of a merge does not
depend on the order of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import strip


def merged_set(column: str) -> F.Column:
    """Sorted distinct union of an array column over a group, without null."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda x: x.isNotNull())))))


def mode_of(counted: F.Column, value: str) -> F.Column:
    """The commonest value, of equal counts the smallest."""
    return F.min_by(value, F.struct(-counted, F.col(value)))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """(name, entity_type, description, source_ids, n): entities of one name become one node.

    Type is the commonest (lower case, ties to the smallest), description the sorted distinct
    texts, source_ids the union.
    """
    rows = nodes.filter("node_type = 'entity' and entity_name is not null").distinct()
    rows = rows.withColumn("name", F.lower(strip(F.col("entity_name")))).filter("name <> ''")
    kinds = rows.withColumn("kind", F.lower(F.coalesce("entity_type", F.lit("")))).filter("kind <> ''").groupBy("name", "kind").agg(F.count("*").alias("n"))
    kind = kinds.groupBy("name").agg(mode_of(F.col("n"), "kind").alias("entity_type"))
    texts = F.array_sort(F.collect_set(F.when(F.col("description") != "", F.col("description"))))
    sources = rows.select("name", F.explode("source_ids").alias("s")).filter("s is not null").distinct().groupBy("name").agg(F.count("*").alias("n_sources"), F.min("s").alias("first_source"))
    merged = rows.groupBy("name").agg(F.array_join(texts, "<SEP>").alias("description"), F.count("*").alias("n"))
    return merged.join(kind, "name", "left").join(sources, "name", "left").select("name", F.coalesce("entity_type", F.lit("")).alias("entity_type"), "description", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "first_source", "n")


def merge_edges(edges: DataFrame) -> DataFrame:
    """(a, b, weight, relations, keywords, n_sources, n): edges of one unordered pair become one.

    Weights add up (null counts 0); names, keywords and sources are sorted unions.
    """
    rows = edges.filter("src is not null and dst is not null").distinct().withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    names = F.array_join(F.filter(merged_set("relation_names"), lambda x: x != ""), "<SEP>")
    return rows.groupBy("a", "b").agg(
        F.round(F.sum(F.coalesce("weight", F.lit(0.0))), 6).alias("weight"),
        names.alias("relations"),
        F.array_join(merged_set("keywords"), "<SEP>").alias("keywords"),
        F.size(merged_set("source_ids")).alias("n_sources"),
        F.count("*").alias("n"),
    )


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, n_sources): ends of edges that are no node, with the sources of their edges."""
    ends = edges.distinct().select(F.explode(F.array("src", "dst")).alias("node_id"), "source_ids").filter("node_id is not null")
    lost = ends.join(nodes.select("node_id").distinct(), "node_id", "left_anti")
    return lost.select("node_id", F.explode_outer("source_ids").alias("s")).groupBy("node_id").agg(F.countDistinct("s").alias("n_sources"))


def entity_chunks(nodes: DataFrame) -> DataFrame:
    """(entity, chunk): the chunks an entity was read from."""
    return nodes.filter("node_type = 'entity'").select(F.col("node_id").alias("entity"), F.explode("source_ids").alias("chunk")).filter("chunk is not null").distinct()


def shared_entity_pairs(mentions: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared): chunks that share at least so many entities.

    Chunks that share t of their n entities share one of the n - t + 1 rarest, so only those
    meet in a join; an entity that a third of all chunks mention pairs up nothing.
    """
    rarity = mentions.groupBy("entity").agg(F.count("*").alias("df"))
    listed = mentions.join(rarity, "entity").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("df", "entity"))).alias("e"))
    listed = listed.filter(F.size("e") >= least).select("chunk", F.transform("e", lambda s: s["entity"]).alias("all"))
    prefix = listed.select("chunk", F.explode(F.slice("all", F.lit(1), F.size("all") - (least - 1))).alias("entity"))
    pairs = prefix.withColumnRenamed("chunk", "a").join(prefix.withColumnRenamed("chunk", "b"), "entity").filter("a < b").select("a", "b").distinct()
    side = lambda n: listed.select(F.col("chunk").alias(n), F.col("all").alias(f"{n}_all"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("a_all", "b_all")))
    return joined.filter(F.col("shared") >= least).select("a", "b", "shared")


def hybrid_edges(nodes: DataFrame, least: int = 2) -> DataFrame:
    """(src, dst, relation, weight): entity in chunk, and chunks that share entities."""
    mentions = entity_chunks(nodes)
    inside = mentions.select(F.col("entity").alias("src"), F.col("chunk").alias("dst"), F.lit("BELONGS_TO").alias("relation"), F.lit(1.0).alias("weight"))
    shared = shared_entity_pairs(mentions, least).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SHARED_ENTITY").alias("relation"), F.col("shared").cast("double").alias("weight"))
    return inside.unionByName(shared)


def title_classes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, title_class, links): passages of one title; links to all others of the class, without listing them."""
    rows = chunks.select("chunk_id", F.lower(strip(F.col("title"))).alias("title")).filter("title <> '' and chunk_id is not null").distinct()
    sizes = rows.groupBy("title").agg(F.min("chunk_id").alias("title_class"), F.count("*").alias("n"))
    return rows.join(sizes, "title").groupBy("chunk_id").agg(F.min("title_class").alias("title_class"), F.sum(F.col("n") - 1).alias("links"))


def incidence(edges: DataFrame) -> DataFrame:
    """(node_id, edge_id): entity x relation incidence."""
    rows = edges.filter("src is not null and dst is not null").select("src", "dst").distinct()
    return rows.select(F.explode(F.array("src", "dst")).alias("node_id"), F.concat_ws("->", "src", "dst").alias("edge_id")).distinct()


def relation_chunks(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(edge_id, chunk_id): relation x chunk incidence, known chunks only."""
    rows = edges.select(F.concat_ws("->", "src", "dst").alias("edge_id"), F.explode("source_ids").alias("chunk_id")).distinct()
    return rows.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select("edge_id", "chunk_id")


def node_text(nodes: DataFrame) -> DataFrame:
    """(node_id, text): name, type and description, blanks skipped."""
    parts = [F.nullif(strip(F.col(c)), F.lit("")) for c in ("entity_name", "entity_type", "description")]
    return nodes.distinct().select("node_id", F.concat_ws(": ", *parts).alias("text"))


def edge_text(edges: DataFrame) -> DataFrame:
    """(src, dst, text): the relation's name, else keywords, ends and description."""
    names = F.array_join(F.filter(F.coalesce("relation_names", F.array().cast("array<string>")), lambda x: x != ""), ", ")
    other = F.concat_ws(" ", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", "), "src", "dst", "description")
    return edges.distinct().select("src", "dst", F.when(names != "", names).otherwise(strip(other)).alias("text"))


def subgraph_text(edges: DataFrame) -> DataFrame:
    """(source, n, text): 'src name dst; ' of all edges of a source, in order of their ends."""
    name = F.coalesce(F.get(F.filter("relation_names", lambda x: x != ""), F.lit(0)), F.lit("related"))
    rows = edges.distinct().select(F.explode("source_ids").alias("source"), "src", "dst", F.concat_ws(" ", "src", name, "dst").alias("t")).distinct()
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "t"))), lambda s: s["t"]), "; ").alias("text"))


def similarity_edges(near: DataFrame, least: float = 0.5, scale: float = 1.0) -> DataFrame:
    """(src, dst, relation, weight) from (owner, other, cosine): the score by the owner's best, no self, from a threshold on."""
    best = near.filter("owner <> other").groupBy("owner").agg(F.max("cosine").alias("top"))
    scored = near.filter("owner <> other").join(best, "owner").withColumn("score", F.try_divide("cosine", F.nullif("top", F.lit(0.0))))
    pairs = scored.filter(F.col("score") >= least).select(F.least("owner", "other").alias("src"), F.greatest("owner", "other").alias("dst"), F.lit("similarity").alias("relation"), (F.col("score") * scale).alias("weight"))
    return pairs.groupBy("src", "dst", "relation").agg(F.max("weight").alias("weight"))
