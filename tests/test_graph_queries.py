import math

import numpy as np
import pytest

from graphloom.plans import graphs

EDGES = "src string, dst string, weight double, relation_names array<string>, keywords array<string>, source_ids array<string>, description string"


@pytest.fixture
def chain(frame, tmp_path):
    """The chain n0 to n6, each edge from a chunk of its own; only n0 is retrieved first."""
    frame([(f"n{i}", f"n{i + 1}", 1.0, ["r"], None, [f"c{i}"], None) for i in range(6)], EDGES).write.parquet(f"{tmp_path}/edges.parquet")
    frame([(f"c{i}",) for i in range(6)], "chunk_id string").write.parquet(f"{tmp_path}/chunks.parquet")
    frame([("entity", 1, "n0")], "kind string, rank int, id string").write.parquet(f"{tmp_path}/retrieval.parquet")
    return str(tmp_path)


def test_converged_pagerank_equals_the_linear_system(spark, chain):
    got = {r.node: r.score for r in graphs.ppr_converged(spark, chain).collect()}
    near = np.diag(np.ones(6), 1) + np.diag(np.ones(6), -1)
    exact = np.linalg.solve(np.eye(7) - 0.5 * (near / near.sum(0)), 0.5 * np.eye(7)[0])
    assert all(math.isclose(got[f"n{i}"], exact[i], abs_tol=2e-6) for i in range(7)) and got["n6"] > 0
    chunks = {r.chunk_id: r.score for r in graphs.chunk_ppr_converged(spark, chain).collect()}
    sums = exact[:-1] + exact[1:]
    assert all(math.isclose(chunks[f"c{i}"], (sums[i] - sums.min()) / (sums.max() - sums.min()), abs_tol=1e-5) for i in range(6))


def test_seed_paths_reach_five_hops(spark, frame, chain, tmp_path):
    frame([("entity", 1, "n0"), ("entity", 1, "n5")], "kind string, rank int, id string").write.mode("overwrite").parquet(f"{tmp_path}/retrieval.parquet")
    got = {(r.seed, r.target): (r.hops, len(r.path)) for r in graphs.seed_paths(spark, chain).collect()}
    assert got == {("n0", "n5"): (5, 6), ("n5", "n0"): (5, 6)}
