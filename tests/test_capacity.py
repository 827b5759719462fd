from graphloom.operators import incremental, trees


def test_balanced_clusters_place_every_copy(frame):
    rows = [(i, [1.0, 2.0]) for i in range(260)] + [(i, [float(i % 17), float(i // 17)]) for i in range(260, 400)]
    got = trees.balanced_clusters(frame(rows, "id int, embedding array<double>"), 5).collect()
    assert sorted(r.id for r in got) == list(range(400))
    sizes = {}
    for r in got:
        sizes[r.cluster] = sizes.get(r.cluster, 0) + 1
    assert max(sizes.values()) <= 5


def test_balanced_clusters_of_equal_rows_only(frame):
    got = trees.balanced_clusters(frame([(i, [1.0, 2.0]) for i in range(30)], "id int, embedding array<double>"), 5).collect()
    assert len(got) == 30 and len({r.cluster for r in got}) == 6


def test_assignment_goes_on_while_there_is_room(frame):
    nodes = frame([(f"n{i:02}", 0b1111) for i in range(24)] + [("far", (1 << 62) - 1)], "node string, signature bigint")
    rooms = frame([(f"c{i}", 0b1111, 0) for i in range(7)], "community string, signature bigint, n int")
    got = {r.node: r.community for r in incremental.assign_by_signature(nodes, rooms, 3).collect()}
    assert len(got) == 25 and sum(c is not None for c in got.values()) == 21 and got["far"] is None
    assert all(list(got.values()).count(f"c{i}") == 3 for i in range(7))


def test_late_rounds_end_with_near_copies(frame, monkeypatch):
    from graphloom.operators import capacity

    monkeypatch.setattr(capacity, "PATIENCE", 1)
    rows = [(i, [1.0 + i * 1e-9, 2.0]) for i in range(150)] + [(i, [float(i % 7), float(i // 7)]) for i in range(150, 200)]
    got = trees.balanced_clusters(frame(rows, "id int, embedding array<double>"), 5).collect()
    assert len(got) == 200 and len({r.cluster for r in got}) == 40
    nodes = frame([(f"n{i:02}", 0b1111 << 8 | i) for i in range(30)], "node string, signature bigint")
    rooms = frame([(f"c{i:02}", 0b1111 << 8, 0) for i in range(10)], "community string, signature bigint, n int")
    placed = incremental.assign_by_signature(nodes, rooms, 3).collect()
    assert len(placed) == 30 and all(r.community is not None for r in placed)
