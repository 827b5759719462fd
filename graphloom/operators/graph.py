"""Iterative graph algorithms on (src, dst) link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node of each connected set of links.

    Each round hooks every root to the smallest root it has a link to, shortens the chains of
    hooks by jumping, and relabels, so that hubs and long chains take a logarithmic number of
    rounds; messages are pre-aggregated by ``min`` before they are shuffled.  Rows with a null
    end are ignored; a self-link gives a component of one node.
    """
    edges = links.filter("src is not null and dst is not null").select("src", "dst")
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")
    label = cut_lineage(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("component")))
    edges = cut_lineage(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    while True:
        # Every label follows its own label until nothing moves, then labels cross the links.
        ends = edges.join(label.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(
            label.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst"
        )
        hooks = ends.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        hooks = cut_lineage(hooks.groupBy("high").agg(F.min("low").alias("low")))
        if hooks.isEmpty():
            return label
        # Roots hook to smaller roots; chains of hooks are then shortened by jumping.
        jump = hooks
        while True:
            longer = jump.alias("x").join(jump.select(F.col("high").alias("low"), F.col("low").alias("lower")), "low", "left")
            jump = cut_lineage(longer.select("high", F.coalesce("lower", "low").alias("low"), F.col("lower").isNotNull().alias("moved")))
            if jump.filter("moved").isEmpty():
                break
            jump = jump.drop("moved")
        moved = label.join(jump.select(F.col("high").alias("component"), "low"), "component", "left")
        label = cut_lineage(moved.select("node", F.coalesce("low", "component").alias("component")))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other, weight): every undirected edge from both ends, once; a self-link once."""
    rows = edges.filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    both = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    ways = rows.select(F.explode(both).alias("e"), "weight").select("e.node", "e.other", "weight")
    return ways.groupBy("node", "other").agg(F.max("weight").alias("weight"))


def node_degree(edges: DataFrame) -> DataFrame:
    """(node, degree): neighbours of a node; a self-link counts twice."""
    return adjacency(edges).groupBy("node").agg(F.sum(F.when(F.col("node") == F.col("other"), 2).otherwise(1)).alias("degree"))


def edge_degree(edges: DataFrame) -> DataFrame:
    """(src, dst, degree): sum of the degrees of both ends."""
    degree = node_degree(edges)
    pairs = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    joined = pairs.join(degree.select(F.col("node").alias("src"), F.col("degree").alias("d1")), "src", "left").join(degree.select(F.col("node").alias("dst"), F.col("degree").alias("d2")), "dst", "left")
    return joined.select("src", "dst", (F.coalesce("d1", F.lit(0)) + F.coalesce("d2", F.lit(0))).alias("degree"))


def k_hop(edges: DataFrame, seeds: DataFrame, k: int, mode: str = "frontier") -> DataFrame:
    """(node, hop): the k-th frontier of the set of seeds, or with mode ``ball`` all within k hops.

    Seeds are visited at hop 0.
    """
    near = adjacency(edges).select("node", "other")
    visited = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = visited
    for hop in range(1, k + 1):
        step = near.join(frontier.select("node"), "node", "left_semi").select(F.col("other").alias("node")).distinct()
        frontier = cut_lineage(step.join(visited.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        visited = visited.unionByName(frontier)
    return frontier if mode == "frontier" else visited


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    keep = nodes.select("node").distinct()
    return edges.distinct().join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi")


def personalized_pagerank(edges: DataFrame, reset: DataFrame, damping: float = 0.5, rounds: int = 20, weighted: bool = True, cut_every: int = 5) -> DataFrame:
    """(node, score): undirected personalised PageRank by power iteration.

    reset: (node, mass); it is normalised, and nodes without links give their mass back to it.
    """
    ways = adjacency(edges).withColumn("weight", F.col("weight") if weighted else F.lit(1.0)).filter("weight > 0")
    out = ways.groupBy("node").agg(F.sum("weight").alias("out"))
    moves = cut_lineage(ways.join(out, "node").select("node", "other", (F.col("weight") / F.col("out")).alias("p")))
    total = reset.agg(F.sum("mass").alias("total"))
    seeds = reset.crossJoin(F.broadcast(total)).groupBy("node").agg((F.sum("mass") / F.max("total")).alias("reset"))
    every = ways.select("node").union(seeds.select("node")).distinct()
    base = cut_lineage(every.join(seeds, "node", "left").select("node", F.coalesce("reset", F.lit(0.0)).alias("reset")).join(out.select("node", F.lit(True).alias("linked")), "node", "left"))
    rank = base.select("node", F.col("reset").alias("score"))
    for i in range(1, rounds + 1):
        sent = moves.join(rank, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("got"))
        lost = rank.join(base.filter("linked is null").select("node"), "node", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        rank = base.join(sent, "node", "left").crossJoin(F.broadcast(lost)).select(
            "node", (F.col("reset") * (1 - damping) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("reset"))).alias("score")
        )
        if i % cut_every == 0 and i < rounds:
            rank = cut_lineage(rank)
    return rank


def propagate_embeddings(edges: DataFrame, vectors: DataFrame, rounds: int = 2) -> DataFrame:
    """(node, embedding): the mean of a node's own and its neighbours' vectors, unit length, some rounds.

    vectors: (node, embedding).  Sums are kept dimension by dimension, so that a hub's
    neighbours are added up before they are shuffled.
    """
    near = adjacency(edges).select("node", "other").filter("node <> other")
    loops = vectors.select("node", F.col("node").alias("other"))
    ways = near.unionByName(loops)
    current = vectors.select("node", "embedding")
    for _ in range(rounds):
        parts = ways.join(current.withColumnRenamed("node", "other"), "other").select("node", F.posexplode("embedding").alias("i", "v"))
        means = parts.groupBy("node", "i").agg(F.avg("v").alias("v"))
        mean = means.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m"))
        length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, v: s + v * v))
        current = cut_lineage(mean.select("node", F.when(length > 0, F.transform("m", lambda v: v / length)).otherwise(F.col("m")).alias("embedding")))
    return current


def label_communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community): synchronous weighted label propagation, ties to the smallest label.

    A node keeps its label unless another has strictly more weight, which stops two sides from
    swapping for ever.
    """
    ways = cut_lineage(adjacency(edges).filter("node <> other").withColumn("weight", F.greatest("weight", F.lit(0.001))))
    label = ways.select("node").distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = ways.join(label.withColumnRenamed("node", "other"), "other").groupBy("node", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.min_by("community", F.struct(-F.round("w", 9), F.col("community"))).alias("best"), F.max(F.round("w", 9)).alias("top"))
        own = label.join(votes.withColumnRenamed("w", "own"), ["node", "community"], "left")
        moved = own.join(best, "node").select("node", F.when(F.col("top") > F.round(F.coalesce("own", F.lit(0.0)), 9), F.col("best")).otherwise(F.col("community")).alias("community"), (F.col("top") > F.round(F.coalesce("own", F.lit(0.0)), 9)).alias("moved"))
        moved = cut_lineage(moved)
        label = moved.select("node", "community")
        if moved.filter("moved").isEmpty():
            break
    return label


def bounded_paths(edges: DataFrame, seeds: DataFrame, cutoff: int = 3) -> DataFrame:
    """(seed, target, hops, path): the shortest path from each seed to its nearest other seeds within the cutoff.

    All seeds are searched together, breadth first; of equal paths the smallest by its nodes is kept.
    Nodes too far from any seed to end a path within the cutoff are not entered.
    """
    near = cut_lineage(adjacency(edges).select("node", "other"))
    ids = seeds.select("node").distinct()
    ball = k_hop(edges, ids, cutoff - 1, mode="ball").select(F.col("node").alias("other"), "hop")
    front = ids.select(F.col("node").alias("seed"), "node", F.array("node").alias("path"))
    seen, hits = front.select("seed", "node"), None
    for hop in range(1, cutoff + 1):
        ways = near.join(ball.filter(F.col("hop") <= cutoff - hop).select("other"), "other", "left_semi")
        step = front.join(ways, "node").select("seed", F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path"))
        step = step.join(seen, ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min("path").alias("path"))
        front = cut_lineage(step)
        found = front.join(ids, "node", "left_semi").select("seed", F.col("node").alias("target"), F.lit(hop).alias("hops"), "path")
        # a seed that has met another is searched no further
        front = front.join(found.select("seed").distinct(), "seed", "left_anti")
        seen = seen.unionByName(front.select("seed", "node"))
        hits = found if hits is None else hits.unionByName(found)
    return hits
