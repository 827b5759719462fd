import math
import random

from graphloom.operators import graph as g
from graphloom.operators import merge, retrieval, steiner

EDGES = "src string, dst string, weight double, relation_names array<string>, keywords array<string>, source_ids array<string>, description string"


def edges(frame, rows):
    return frame([(a, b, w, ["r"], None, ["c"], None) for a, b, w in rows], EDGES)


def test_components_against_union_find(frame):
    rng = random.Random(1)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(5, 5), (None, 1)]
    got = {r.node: r.component for r in g.connected_components(frame(links, "src int, dst int")).collect()}
    parent = {n: n for a, b in links if a is not None for n in (a, b)}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {n: find(n) for n in parent}


def test_components_of_a_chain_and_of_nothing(frame):
    chain = g.connected_components(frame([(i, i + 1) for i in range(60)], "src int, dst int")).collect()
    assert {r.component for r in chain} == {0} and len(chain) == 61
    assert g.connected_components(frame([], "src int, dst int")).count() == 0


def test_degrees_self_link_and_both_directions(frame):
    e = edges(frame, [("a", "b", 1.0), ("b", "a", 2.0), ("a", "a", None), ("a", "c", 1.0), ("a", "c", 1.0)])
    assert {r.node: r.degree for r in g.node_degree(e).collect()} == {"a": 4, "b": 1, "c": 1}
    assert {(r.src, r.dst): r.degree for r in g.edge_degree(e).collect()}["a", "b"] == 5


def test_k_hop_frontier_and_ball(frame):
    e = edges(frame, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("b", "a", 1.0)])
    seeds = frame([("a",)], "node string")
    assert {r.node for r in g.k_hop(e, seeds, 2).collect()} == {"c"}
    assert {r.node for r in g.k_hop(e, seeds, 2, mode="ball").collect()} == {"a", "b", "c"}


def test_pagerank_sums_to_one_and_matches_numpy(frame):
    links = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("c", "d", 0.5)]
    rank = {r.node: r.score for r in g.personalized_pagerank(edges(frame, links), frame([("a", 2.0), ("z", 2.0)], "node string, mass double"), rounds=12).collect()}
    assert math.isclose(sum(rank.values()), 1.0, abs_tol=1e-9)
    names = ["a", "b", "c", "d", "z"]
    w = {n: {} for n in names}
    for a, b, x in links:
        w[a][b] = w[b][a] = x
    reset = {"a": 0.5, "z": 0.5}
    cur = {n: reset.get(n, 0.0) for n in names}
    for _ in range(12):
        lost = cur["z"]
        cur = {n: reset.get(n, 0) * 0.5 + 0.5 * (sum(cur[m] * w[m][n] / sum(w[m].values()) for m in w[n]) + lost * reset.get(n, 0)) for n in names}
    assert all(math.isclose(rank[n], cur[n], abs_tol=1e-9) for n in names)


def test_propagation_is_the_mean_of_neighbours(frame):
    e = edges(frame, [("a", "b", 1.0)])
    got = {r.node: r.embedding for r in g.propagate_embeddings(e, frame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.0])], "node string, embedding array<double>"), 1).collect()}
    assert all(math.isclose(x, math.sqrt(0.5)) for x in got["a"]) and got["c"] == [0.0, 0.0]


def test_label_communities_split_two_cliques(frame):
    pairs = [(f"{s}{i}", f"{s}{j}", 1.0) for s in "xy" for i in range(5) for j in range(i)] + [("x0", "y0", 0.1)]
    got = {r.node: r.community for r in g.label_communities(edges(frame, pairs)).collect()}
    assert len({got[f"x{i}"] for i in range(5)}) == 1 and len({got[f"y{i}"] for i in range(5)}) == 1 and got["x1"] != got["y1"]


def test_paths_between_seeds(frame):
    e = edges(frame, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])
    got = {(r.seed, r.target): r.path for r in g.bounded_paths(e, frame([("a",), ("c",)], "node string"), 3).collect()}
    assert got == {("a", "c"): ["a", "b", "c"], ("c", "a"): ["c", "b", "a"]}


def test_shared_pairs_equal_brute_force(frame):
    rng = random.Random(3)
    rows = sorted({(f"e{rng.randrange(25)}", f"c{rng.randrange(30)}") for _ in range(260)} | {("hub", f"c{i}") for i in range(30)})
    got = {(r.a, r.b): r.shared for r in merge.shared_entity_pairs(frame(rows, "entity string, chunk string"), 3).collect()}
    by = {}
    for e, c in rows:
        by.setdefault(c, set()).add(e)
    assert got == {(a, b): len(by[a] & by[b]) for a in by for b in by if a < b and len(by[a] & by[b]) >= 3}


def test_merge_edges_of_both_directions_and_nulls(frame):
    e = frame([("b", "a", 1.5, ["x", ""], ["k"], ["s1"], None), ("a", "b", None, None, None, None, "d"), ("a", "b", None, None, None, None, "d")], EDGES)
    (row,) = merge.merge_edges(e).collect()
    assert (row.a, row.b, row.weight, row.relations, row.keywords, row.n_sources, row.n) == ("a", "b", 1.5, "x", "k", 1, 2)


def test_merge_nodes_ties_and_blanks(frame):
    schema = "node_id string, node_type string, entity_name string, entity_type string, description string, source_ids array<string>"
    rows = [("1", "entity", " Ann ", "B", "x", ["s"]), ("2", "entity", "ann", "a", None, None), ("3", "entity", None, "a", "", []), ("4", "entity", " ", "a", "", [])]
    (row,) = merge.merge_nodes(frame(rows, schema)).collect()
    assert (row.name, row.entity_type, row.description, row.n_sources, row.n) == ("ann", "a", "x", 1, 2)


def test_steiner_tree_takes_what_pays(frame):
    e = edges(frame, [("a", "m", 1.0), ("m", "b", 1.0), ("a", "x", 1.0)])
    got = {(r.src, r.dst) for r in steiner.steiner_subgraphs(e, frame([(1, "a", 3.0), (1, "b", 2.0)], "query_id long, id string, prize double")).collect()}
    assert got == {("a", "m"), ("m", "b")}
    assert steiner.grow({}, {}, 1.0) == []


def test_beam_and_budget(frame):
    e = edges(frame, [("a", "b", 0.9), ("a", "c", 0.1), ("b", "d", 0.5)])
    got = retrieval.beam_search(e, frame([("a",)], "node string"), width=1, depth=2).collect()
    assert {(r.step, r.node) for r in got} == {(1, "b"), (2, "d")}
    from pyspark.sql import functions as F

    rows = frame([(1, i, n) for i, n in enumerate([3, 9, 1])], "q int, pos int, t int")
    kept = retrieval.budget_prefix(rows, 10, ["q"], [F.col("pos")], F.col("t")).collect()
    assert [r.pos for r in kept] == [0]


def test_exact_knn_ties_and_nulls(frame):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(40, 4)).round(3)
    rows = [(i, [float(v) for v in x[i]]) for i in range(40)] + [(40, None), (41, [float(v) for v in x[0]])]
    v = frame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in retrieval.exact_knn(v, v.filter("vec_id % 10 = 0"), 3, "vec_id", "embedding").collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    full = {i: np.array(e) for i, e in rows if e}
    for q in (0, 10, 20, 30):
        order = sorted((round(-float(full[q] @ full[i]), 9), i) for i in full if i != q)[:3]
        assert [got[q][k] for k in (1, 2, 3)] == [i for _, i in order]
