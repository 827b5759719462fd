"""Prize-collecting subgraphs: connected node sets whose prizes outweigh their edges."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import adjacency


def grow(prizes: dict[str, float], near: dict[str, list[str]], cost: float) -> list[tuple[str, str]]:
    """Edges of a tree: from the greatest prize, the cheapest path to a prize worth more than the path, again and again.

    Leaves whose prize does not pay for their edge are cut off at the end.
    """
    if not prizes:
        return []
    root = min(prizes, key=lambda n: (-prizes[n], n))
    inside, edges = {root}, []
    while True:
        queue = [(0.0, n, "") for n in sorted(inside)]
        dist, back, best = {n: 0.0 for n in inside}, {}, None
        while queue:
            d, n, _ = heapq.heappop(queue)
            if d > dist.get(n, 1e18):
                continue
            if n not in inside and prizes.get(n, 0) > d and (best is None or prizes[n] - d > best[0]):
                best = (prizes[n] - d, n)
            for m in near.get(n, ()):
                step = d + cost
                if m not in inside and step < dist.get(m, 1e18):
                    dist[m], back[m] = step, n
                    heapq.heappush(queue, (step, m, n))
        if best is None:
            break
        n = best[1]
        while n not in inside:
            edges.append((back[n], n))
            inside.add(n)
            n = back[n]
    while True:
        ends: dict[str, list[tuple[str, str]]] = {}
        for e in edges:
            for n in e:
                ends.setdefault(n, []).append(e)
        loose = [(e[0], n) for n, e in ends.items() if len(e) == 1 and n != root and prizes.get(n, 0) < cost]
        if not loose:
            return edges
        edges = [e for e in edges if e not in {x for x, _ in loose}]


def steiner_subgraphs(edges: DataFrame, prizes: DataFrame, cost: float = 0.5) -> DataFrame:
    """(query_id, src, dst): for each query the tree grown over its candidates' neighbourhood.

    prizes: (query_id, id, prize) with a bounded number of rows a query.  Candidates are the
    edges between prized nodes and the nodes that join two of them, so a group stays small.
    """
    near = adjacency(edges).select("node", "other").filter("node <> other")
    first = prizes.join(near, F.col("id") == F.col("node")).select("query_id", "node", "other")
    joining = first.groupBy("query_id", "other").agg(F.countDistinct("node").alias("k")).filter("k >= 2").select("query_id", "other")
    kept = first.join(joining, ["query_id", "other"], "left_semi").unionByName(first.join(prizes.select("query_id", F.col("id").alias("other")), ["query_id", "other"], "left_semi")).distinct()
    grouped = kept.groupBy("query_id").agg(F.collect_list(F.struct("node", "other")).alias("links"))
    worth = prizes.groupBy("query_id").agg(F.collect_list(F.struct("id", "prize")).alias("prizes"))

    def run(frames):
        for frame in frames:
            out = []
            for q, links, worth_of in zip(frame.query_id, frame.links, frame.prizes):
                own: dict[str, list[str]] = {}
                for x in sorted((x["node"], x["other"]) for x in (links if links is not None else [])):
                    own.setdefault(x[0], []).append(x[1])
                    own.setdefault(x[1], []).append(x[0])
                out += [(q, a, b) for a, b in grow({p["id"]: float(p["prize"]) for p in worth_of}, own, cost)]
            yield pd.DataFrame(out, columns=["query_id", "src", "dst"])

    return worth.join(grouped, "query_id", "left").select("query_id", "links", "prizes").mapInPandas(run, "query_id bigint, src string, dst string")
