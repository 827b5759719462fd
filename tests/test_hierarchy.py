import datetime as dt
import random

from graphloom.operators import hierarchy as h

STATE = "node_id string, parent string, updated_at timestamp, node string"
COMM = "community_id string, members array<string>, sub_communities array<string>, parent string"
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def found(frame, state, comm=()):
    rows = h.found_hierarchy(frame([(*r, "x") for r in state], STATE), frame([(*r, "x") for r in comm], COMM)).collect()
    return {r.node_id: (r.root_id, r.depth, r.state) for r in rows}


def test_latest_parent_then_listing(frame):
    state = [("A", None, T0), ("b", "c", T1), ("b", " a ", T1 + dt.timedelta(days=1)), ("b", "zz", T0), ("C", "", T0), ("d", "nope", T0), ("d", "nope", T0)]
    got = found(frame, state, [("c", ["X"], ["D\t", None]), (" A", [" c"], None), (None, ["b"], None)])
    assert got == {"A": ("A", 0, "tree"), "b": ("A", 1, "tree"), "C": ("A", 1, "tree"), "d": ("A", 2, "tree")}


def test_cycles(frame):
    state = [("a", "b", T0), ("b", "a", T0), ("c", "a", T0), ("d", "c", T0), ("s", "s", T0), ("t", "s", T0)]
    got = found(frame, state)
    assert {k: v[2] for k, v in got.items()} == {"a": "cycle", "b": "cycle", "c": "below_cycle", "d": "below_cycle", "s": "cycle", "t": "below_cycle"}
    assert all(v[:2] == ("", -1) for v in got.values())


def test_empty_and_null(frame):
    assert found(frame, []) == {}
    assert found(frame, [(None, "a", T0), ("a", None, None), (" ", None, T0)]) == {"a": ("a", 0, "tree")}


def test_against_brute_force(frame):
    rng = random.Random(5)
    parent = {f"n{i}": (f"n{rng.randrange(200)}" if rng.random() < 0.85 else None) for i in range(200)}
    tree = h.hierarchy(frame(list(parent.items()), "node string, parent string"))
    rows = {r.node: r for r in tree.collect()}
    below = {(r.ancestor, r.descendant, r.distance) for r in h.descendants(tree).collect()}
    expected = set()
    for n in parent:
        up, x = [n], n
        while parent[x] is not None and parent[x] not in up:
            x = parent[x]
            up.append(x)
        again = parent[x]
        state = "tree" if again is None else "cycle" if again == n or n in up[up.index(again):] else "below_cycle"
        assert rows[n].state == state
        if state == "tree":
            assert (rows[n].root, rows[n].depth, rows[n].path) == (up[-1], len(up) - 1, up[::-1])
            expected |= {(a, n, i) for i, a in enumerate(up) if i}
    assert below == expected
    sizes = {n: 1 + sum(a == n for a, _, _ in expected) for n in parent if rows[n].state == "tree"}
    assert {n: rows[n].size for n in sizes} == sizes


def test_long_chain(frame):
    rows = h.hierarchy(frame([(f"{i:02d}", f"{i - 1:02d}" if i else None) for i in range(12)], "node string, parent string"), with_path=False).collect()
    assert max(r.depth for r in rows) == 11 and {r.root for r in rows} == {"00"}
