"""Preset compositions: which builder and which search each shipped configuration uses."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import chunking, embed, evaluate
from graphloom.plans import build, graphs, more, queries, search, strategies
from graphloom.registry import BUILDERS, CHUNKERS, EMBEDDERS, METRICS, RETRIEVERS, STRATEGIES


class Preset(NamedTuple):
    """Names in BUILDERS and STRATEGIES."""

    builder: str
    strategy: str


CHUNKERS |= {"token_size": chunking.token_windows, "separator": chunking.separator_chunks}
EMBEDDERS |= {"hashing": embed.hashing_embedder}
METRICS |= {"match": evaluate.match, "token_f1": evaluate.token_f1, "bleu4": evaluate.bleu4, "rouge_l": evaluate.rouge_l, "multi_answer": evaluate.multi_answer}
BUILDERS |= {
    "hybrid": graphs.hybrid_edges, "entity_relation": build.entity_relation_edges, "rich": build.rich_graph_edges, "passage": graphs.passage_graph,
    "tree": strategies.soft_tree, "balanced_tree": strategies.balanced_kmeans, "none": build.zero_shot,
}
RETRIEVERS |= {
    "entity_vdb": search.typed_text_search, "relation_vdb": search.relation_vdb, "chunk_ppr": graphs.chunk_ppr_converged, "relations_by_score": build.relations_by_score,
    "tails_by_score": build.tails_by_score, "relations_between": build.relations_between, "neighbors": graphs.neighbors, "paths": graphs.seed_paths, "expansion": more.neighbor_expand, "flat": search.flat_search,
}


def path_and_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seed, part, text): paths between the seeds and the seeds' neighbourhood, as lines of node ids."""
    from pyspark.sql import functions as F

    paths = graphs.seed_paths(spark, sf_dir).select("seed", F.lit("path").alias("part"), F.array_join("path", " -> ").alias("text"))
    near = strategies.subgraph(spark, sf_dir).select(F.col("src").alias("seed"), F.lit("neighbour").alias("part"), F.concat_ws(" -> ", "src", "dst").alias("text"))
    return paths.unionByName(near)


STRATEGIES |= {
    "tree": search.collapsed_tree_search, "local": strategies.basic_local, "global": build.strategy_global_reports, "keywords": search.strategy_global_keywords, "hybrid": queries.hybrid_union,
    "ppr": strategies.passage_rank, "packed": strategies.packed_context, "passage_walk": queries.tfidf_topk, "beam": queries.beam_search, "steiner": strategies.pcst_subgraph,
    "metagraph": strategies.subgraph, "path_and_neighbour": path_and_neighbour, "flat_tree": search.flat_search, "zero_shot": build.zero_shot,
}

PRESETS = {
    "headline_static": Preset("hybrid", "flat_tree"), "headline_dynamic": Preset("hybrid", "flat_tree"), "ppr": Preset("entity_relation", "ppr"), "tree": Preset("tree", "tree"),
    "community_local": Preset("rich", "local"), "community_global": Preset("rich", "global"), "keyword_local": Preset("rich", "local"), "keyword_global": Preset("rich", "keywords"),
    "keyword_hybrid": Preset("rich", "hybrid"), "passage_walk": Preset("passage", "passage_walk"), "beam_search": Preset("entity_relation", "beam"), "steiner": Preset("entity_relation", "steiner"),
    "metagraph": Preset("entity_relation", "metagraph"), "path_and_neighbour": Preset("entity_relation", "path_and_neighbour"), "control": Preset("none", "zero_shot"),
}


def run(preset: str, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(graph, answer context) of a preset over a data directory."""
    chosen = PRESETS[preset]
    return BUILDERS.find(chosen.builder)(spark, sf_dir), STRATEGIES.find(chosen.strategy)(spark, sf_dir)
