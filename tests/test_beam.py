import math
import random

import pytest

from graphloom.operators import retrieval

EDGES = "src string, dst string, weight double"


def brute(edges, seeds, width, depth):
    near = {}
    for a, b, w in edges:
        if a is not None and b is not None and a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})
                near[x][y] = max(near[x].get(y, -math.inf), w or 0.0)
    out = set()
    for seed in seeds:
        front, visited = {seed: 1.0}, {seed}
        for step in range(1, depth + 1):
            moves = {}
            for node, score in front.items():
                for other, w in near.get(node, {}).items():
                    if other not in visited:
                        moves[other] = max(moves.get(other, 0.0), score * max(w, 0.001))
            front = dict(sorted(moves.items(), key=lambda m: (-m[1], m[0]))[:width])
            visited |= front.keys()
            out |= {(seed, step, node, score) for node, score in front.items()}
    return out


@pytest.mark.parametrize(("limit", "weights"), [(300_000, [0.0, 0.25, 0.5, 1.0, None]), (0, [0.125, 0.5, 0.75]), (300_000, [1.0, math.inf, 0.5])])
def test_beam_equals_all_moves(frame, monkeypatch, limit, weights):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", limit)
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice(weights)) for _ in range(150)] + [(None, "n1", 1.0), ("n1", "n1", 9.0)]
    edges += [("n0", f"n{i}", rng.choice(weights)) for i in range(60)]
    seeds = [f"n{i}" for i in range(0, 60, 4)] + ["nobody"]
    for width, depth in ((3, 3), (2, 4)):
        got = retrieval.beam_search(frame(edges, EDGES), frame([(s,) for s in seeds], "node string"), width, depth).collect()
        assert {(r.seed, r.step, r.node, r.score) for r in got} == brute(edges, seeds, width, depth)


def test_a_hub_sends_its_strongest_links_only(frame):
    links = frame([("hub", f"n{i:04}", 1.0 + i % 7) for i in range(3000)], EDGES)
    got = [r for r in retrieval.strongest(links, 10).collect() if r.node == "hub"]
    assert [(r.other, r.weight) for r in sorted(got, key=lambda r: r.other)] == [(f"n{i:04}", 7.0) for i in range(6, 76, 7)]
