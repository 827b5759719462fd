import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import clusters, neighbours

SCHEMA = "owner_id string, owner_type string, space string, level int, embedding array<float>, vec string"


def make(frame, rows):
    return frame([(o, "entity", s, l, None if e is None else [float(x) for x in e], "x") for o, s, l, e in rows], SCHEMA)


def dirty(width=64):
    return [("z0", "node", 0, [0.0] * width), ("z1", "node", 0, None), ("z2", "node", 0, [1.0] * 32), (None, "node", 0, [1.0] * width), ("z3", None, 0, [1.0] * width)]


def planted(seed, groups, near, noise):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=64)
        for i in range(near):
            rows.append((f"g{g:02d}_{i:03d}", centre + rng.normal(size=64) * 0.12))
    rows += [(f"n{i:04d}", rng.normal(size=64)) for i in range(noise)]
    return rows


def unit(rows):
    x = np.array([e for _, e in rows], np.float32).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_mutual_pairs_equal_brute_force(frame):
    rows = planted(1, 12, 14, 400)
    rows += [(f"copy{i:02d}", rows[0][1]) for i in range(15)]
    x, ids = unit(rows), np.array([o for o, _ in rows])
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    top = {(i, j) for i in range(len(ids)) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:10] if s[i, j] >= 0.97}
    truth = {tuple(sorted((ids[i], ids[j]))) for i, j in top if (j, i) in top}
    table = make(frame, [(o, "node", 0, e) for o, e in rows] + [(o, "node", 0, e) for o, e in rows[:20]] + dirty())
    got = {(r.owner_a, r.owner_b) for r in neighbours.mutual_pairs(table).collect()}
    assert got == truth and truth


def test_recall_of_the_k_most_similar(frame):
    rows = planted(2, 40, 20, 1500)
    x, ids = unit(rows), [o for o, _ in rows]
    table = make(frame, [(o, "node_text", None, e) for o, e in rows])
    found = {}
    for r in neighbours.most_similar(table, 10, neighbours_query()).collect():
        found.setdefault(r.owner, set()).add(r.other)
    hits = total = 0
    for o, others in found.items():
        s = x @ x[ids.index(o)]
        s[ids.index(o)] = -2
        true = {ids[j] for j in np.argsort(-s)[:10] if s[j] > 0.5}
        hits, total = hits + len(true & others), total + len(true)
    assert total and hits / total >= 0.9


def neighbours_query():
    return "pmod(xxhash64(owner_id), 10) = 0"


def test_empty_searches(frame):
    assert neighbours.mutual_pairs(make(frame, dirty())).count() == 0
    assert neighbours.mutual_pairs(make(frame, [])).count() == 0
    assert clusters.clusters(make(frame, [])).count() == 0
    assert neighbours.mutual_pairs(make(frame, [("a", "node", 0, [1.0] * 64)])).count() == 0


def test_quantiser_beats_its_first_codebook():
    x = unit(planted(3, 10, 60, 400)).astype(np.float32)
    q = neighbours.AdditiveQuantiser.fit(x, 16, codebooks=12)
    packed, near = q.encode(x)
    back = q.reconstruct(packed)
    assert np.allclose(((x - back) ** 2).sum(1), packed["left"], atol=1e-4) and np.allclose((back**2).sum(1), packed["norm"], atol=1e-4)
    first = ((x - q.first[near[:, 0]]) ** 2).sum(1)
    assert packed["left"].mean() < 0.7 * first.mean()
    # the look-up tables give the products of the reconstructions
    assert np.allclose(q.scores(x[:20], packed[:50]), back[:50] @ x[:20].T, atol=1e-4)


def test_beam_is_no_worse_than_greedy(monkeypatch):
    x = unit(planted(3, 10, 60, 4000)).astype(np.float32)
    q = neighbours.AdditiveQuantiser.fit(x, 16, codebooks=16)
    wide = q.encode(x)[0]["left"].mean()
    monkeypatch.setattr(neighbours, "BEAM", 1)
    assert wide <= q.encode(x)[0]["left"].mean()


def test_beam_keeps_the_best_paths():
    x = unit(planted(3, 10, 60, 400)).astype(np.float32)
    q = neighbours.AdditiveQuantiser.fit(x, 16, codebooks=6)
    rest = x[:50] - q.first[q.encode(x[:50])[0]["first"]]
    codes, cost = q.beam(rest)
    books = q.words.reshape(6, neighbours.CODEWORDS, 64)
    for r, own, least in zip(rest, codes, cost):
        paths = [(0.0, ())]
        for m in range(6):
            paths = [p + (w,) for _, p in paths for w in range(neighbours.CODEWORDS)]
            paths = sorted((0.5 * ((r - sum(books[k][w] for k, w in enumerate(p))) ** 2).sum(), p) for p in paths)[: neighbours.BEAM]
        assert tuple(own) == paths[0][1] and abs(least - paths[0][0]) < 1e-5


def test_two_query_rows_of_a_list_are_given_once(frame):
    centre = np.random.default_rng(6).normal(size=64)
    shake = np.random.default_rng(7).normal(size=(40, 64))
    table = make(frame, [(f"g{i:02d}", "node", 0, centre + 0.02 * e) for i, e in enumerate(shake)] + [(f"far{i}", "node", 0, -centre + 3 * e) for i, e in enumerate(shake)])
    model = neighbours.fit_quantisers(table)["node"]
    rows = neighbours.usable(table).filter("owner_id like 'g%'").collect()
    homes = model.encode(unit([("", r.embedding) for r in rows]).astype(np.float32))[0]["first"]
    home = {r.vec: h for r, h in zip(rows, homes)}
    got = [(r["query"], r.member) for r in neighbours.candidate_pairs(table, 0.97, 0).collect()]
    same = [(a, b) for a, b in got if a in home and b in home and home[a] == home[b]]
    assert same and len({frozenset(p) for p in same}) == len(same)


def test_a_list_is_left_out_only_if_it_holds_nothing_near():
    rng = np.random.default_rng(9)
    x = unit([("", e) for e in rng.normal(size=(3000, 64))]).astype(np.float32)
    q = neighbours.AdditiveQuantiser.fit(x, 64, codebooks=2)
    reach = 0.06
    step = rng.normal(size=x.shape)
    y = x + 0.999 * reach**0.5 * step / np.linalg.norm(step, axis=1)[:, None]
    y = (y / np.linalg.norm(y, axis=1)[:, None]).astype(np.float32)
    near, home = q.encode(x)[1], q.encode(y)[1][:, 0]
    visited = q.reached(x, near, reach)
    close = ((x - y) ** 2).sum(axis=1) <= reach
    there = (near == home[:, None]) & close[:, None]
    assert there[:, 1:].sum() > 100 and visited[there].all() and visited[:, 0].all()
    # words far apart, rows at one of them
    assert q.reached(q.first, q.encode(q.first)[1], 1e-4).sum() < 1.5 * len(q.first)


def test_cosines_are_summed_in_order():
    x, y = np.random.default_rng(1).normal(size=(2, 30, 64)).astype(np.float32)

    def dot(a, b):
        total = 0.0
        for p, q in zip(a.tolist(), b.tolist()):
            total += p * q
        return total

    assert neighbours.exact_cosine(x, y).tolist() == [dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 for a, b in zip(x, y)]


def test_vectors_with_null_or_nan_take_no_part(frame):
    good = [float(i + 1) for i in range(64)]
    rows = [("a", good), ("b", [2 * e for e in good]), ("c", [None, *good[1:]]), ("d", [float("nan"), *good[1:]]), ("e", [None, float("nan"), *good[2:]]), ("f", [None] * 64)]
    table = frame([(o, "node", "node", 0, e, "x") for o, e in rows], SCHEMA)
    assert [tuple(r) for r in neighbours.mutual_pairs(table).collect()] == [("node", "a", "b")]


@pytest.mark.parametrize("seed", [4, 5])
def test_groups_equal_components(frame, seed):
    rng = np.random.default_rng(seed)
    rows, levels = [], []
    for g, size in enumerate([60, 25, 6, 5, 4, 1]):
        centre = rng.normal(size=64)
        for i in range(size):
            rows.append((f"g{g}_{i:02d}", centre + rng.normal(size=64) * 0.35))
            levels.append(g % 2)
    chain = [rng.normal(size=64)]
    for _ in range(5):
        step = rng.normal(size=64)
        chain.append(chain[-1] / np.linalg.norm(chain[-1]) + 0.6 * step / np.linalg.norm(step))
    rows += [(f"chain{i}", e) for i, e in enumerate(chain)] + [(f"n{i:03d}", rng.normal(size=64)) for i in range(150)]
    levels += [0] * (len(rows) - len(levels))
    x, ids = unit(rows), [o for o, _ in rows]
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if levels[i] == levels[j] and x[i] @ x[j] >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, o in enumerate(ids):
        groups.setdefault(find(i), []).append(o)
    truth = {o: min(g) for g in groups.values() if len(g) >= 5 for o in g}
    table = make(frame, [(o, "node", l, e) for (o, e), l in zip(rows, levels)] + [(rows[0][0], "node", levels[0], rows[0][1]), ("q", "node", None, rows[0][1])] + dirty())
    assert {r.owner_id: r.cluster_key for r in clusters.clusters(table).collect()} == truth


def test_chain_between_two_pivots_is_one_group(frame):
    # pivots at 0 and 108 degrees, records at 36 and 72: neighbours are similar, nothing else is
    rng = np.random.default_rng(2)
    for turn in range(6):
        e, f = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        rows = [(f"t{turn}_{d:03d}", np.cos(np.radians(d)) * e + np.sin(np.radians(d)) * f) for d in (0, 18, 36, 72, 90, 108)]
        table = make(frame, [(o, "node", 0, x) for o, x in rows] + [(f"n{i}", "node", 0, rng.normal(size=64)) for i in range(60)])
        assert {r.owner_id for r in clusters.clusters(table).collect()} == {o for o, _ in rows}


def test_long_lists_are_split_without_loss(frame, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    rows = [(f"g{i:03d}", "node", 0, centre + 0.4 * rng.normal(size=64)) for i in range(300)] + [(f"n{i}", "node", 0, rng.normal(size=64)) for i in range(200)]
    whole = {tuple(r) for r in clusters.clusters(make(frame, rows)).collect()}
    monkeypatch.setattr(clusters, "SPLIT_ROWS", 20)
    assert {tuple(r) for r in clusters.clusters(make(frame, rows)).collect()} == whole and len(whole) == 300


def test_records_without_a_pivot_meet_whatever_their_nearest_pivots(frame, monkeypatch):
    # pairs of 36 degrees in noise: hardly any shares a pivot among the five nearest of each
    rng = np.random.default_rng(11)
    rows = []
    for g in range(40):
        axes = np.linalg.qr(rng.normal(size=(64, 6)))[0].T
        rows += [(f"g{g:02d}_{i}", e) for i, e in enumerate(chain(axes, 36))]
    rows += [(f"n{i:04d}", rng.normal(size=64)) for i in range(1500)]
    table = make(frame, [(o, "node", 0, e) for o, e in rows])
    want = {(o, f"{o[:3]}_0") for o, _ in rows if o[0] == "g"}
    assert {tuple(r) for r in clusters.clusters(table).select("owner_id", "cluster_key").collect()} == want
    monkeypatch.setattr(clusters, "LEAST_SIDE", 64)
    assert {tuple(r) for r in clusters.clusters(table).select("owner_id", "cluster_key").collect()} == want


def chain(axes, degrees):
    """Unit vectors of which each is similar to the next only: every step leaves the plane of the one before."""
    out = [axes[0]]
    for axis in axes[1:]:
        out.append(np.cos(np.radians(degrees)) * out[-1] + np.sin(np.radians(degrees)) * axis)
    return out


def test_many_copies_leave_their_neighbours_a_pivot(frame):
    e, f = np.linalg.qr(np.random.default_rng(0).normal(size=(64, 2)))[0].T
    kinds = [np.cos(np.radians(d)) * e + np.sin(np.radians(d)) * f for d in (0, 30, 60)]
    table = make(frame, [(f"c{k}", "node", level, x) for level in range(3) for k, x in enumerate(kinds)])
    many = table.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40_000)))).withColumn("owner_id", F.concat("owner_id", F.format_string("_%05d", "n")))
    got = clusters.clusters(many).groupBy("level", "cluster_key").count().collect()
    assert sorted(map(tuple, got)) == [(level, "c0_00001", 120_000) for level in range(3)]


def test_visitors_of_a_list_leave_one_link_each():
    # all visit the list, and every two of them are similar
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    x = np.array([centre + 0.3 * rng.normal(size=64) for _ in range(4000)], np.float32)
    pivot = clusters.Pivots(np.array([7]), x[:1] / np.linalg.norm(x[:1]), 0.80)
    n = len(x)
    role = np.r_[np.full(1000, clusters.MEMBER), np.full(n - 1000, clusters.VISITOR)]
    packed = clusters.packed_units(x / np.linalg.norm(x, axis=1)[:, None])
    columns = [np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32), role.astype(np.int32), np.arange(100, n + 100)]
    task = pa.table([*map(pa.array, columns), pa.array([r.tobytes() for r in packed], pa.binary())], ["level", "list", "part", "role", "vec", "x"])
    tracemalloc.start()
    links = pa.Table.from_batches(clusters.connect_rows(task, {0: pivot}))
    assert links.num_rows == n and tracemalloc.get_traced_memory()[1] < 60e6
    assert (clusters.tile_groups(packed, None, 0.80) == 0).all() and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_tiles_group_like_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.array(chain(np.linalg.qr(rng.normal(size=(64, 8)))[0].T, 35)) for _ in range(50)])
    packed = clusters.packed_units(x)
    monkeypatch.setattr(clusters, "ASK_ROWS", 16)
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 48)
    monkeypatch.setattr(clusters, "HELD_PAIRS", 20)
    assert (clusters.tile_groups(packed, None, 0.80) == np.arange(400) // 8 * 8).all()
    order = rng.permutation(400)
    group = clusters.tile_groups(packed[order[:150]], packed[order[150:]], 0.80)
    apart = (order[:, None] < 400) & ((np.arange(400) < 150)[:, None] != (np.arange(400) < 150))
    link = (x[order] @ x[order].T >= 0.80) & apart
    reach = np.eye(400, dtype=bool) | link
    for _ in range(9):
        reach = reach.astype(np.float32) @ reach.astype(np.float32) > 0
    assert (group == reach.argmax(axis=1)).all()


def test_copies_form_a_group_and_are_described(frame):
    e = np.random.default_rng(0).normal(size=64)
    table = make(frame, [(f"c{i}", "node", 1, e) for i in range(6)])
    assert {r.cluster_key for r in clusters.clusters(table).collect()} == {"c0"}
    (row,) = clusters.describe_clusters(table).collect()
    assert (row["size"], row.medoid, row.typical) == (6, "c0", ["c0", "c1", "c2"])
