import json

from pyspark.sql import functions as F

from graphloom.operators import trees
from graphloom.sources import io


def test_corpus_and_questions(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text("\n".join(json.dumps({"title": t, "context": c, "id": 9}) for t, c in (("a", "x"), (None, "y"))))
    assert [(r.doc_id, r.title, r.content) for r in io.read_corpus(spark, str(path)).orderBy("doc_id").collect()] == [(0, "a", "x"), (1, "", "y")]
    path.write_text(json.dumps({"question": "q", "answer": "a|b", "id": 1, "options": {"A": "x"}}))
    row = io.read_questions(spark, str(path)).first()
    assert row.options == {"A": "x"} and row.answer_idx is None


def test_load_or_build(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return {"t": spark.range(3)}

    for _ in range(2):
        assert io.load_or_build(spark, str(tmp_path / "s"), build, ["t"])["t"].count() == 3
    assert len(built) == 1


def test_graphml_round_trip(spark, frame, tmp_path):
    nodes, edges = frame([("a&b",), ("c",)], "node_id string"), frame([("a&b", "c", 0.5), ("a&b", "c", 0.25)], "src string, dst string, weight double")
    io.write_graphml(nodes, edges, str(tmp_path / "g"))
    n, e = io.read_graphml(spark, str(tmp_path / "g"))
    assert sorted(r.node_id for r in n.collect()) == ["a&b", "c"] and [tuple(r) for r in e.collect()] == [("a&b", "c", 0.5)]


def test_pending(frame):
    assert [r.id for r in io.pending(frame([(1,), (2,)], "id int"), frame([(1,)], "id int")).collect()] == [2]


def test_balanced_clusters(frame):
    rows = frame([(i, [float(i % 7), float(i // 7)]) for i in range(30)], "id int, embedding array<double>")
    got = trees.balanced_clusters(rows, 8).groupBy("cluster").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 30 and max(r.n for r in got) <= 8


def test_soft_tree_covers_all(frame):
    rows = frame([(i, [float(i % 2) * 9 + i * 0.01, float(i % 3), 1.0]) for i in range(40)], "id int, embedding array<double>")
    assert trees.soft_clusters(rows, reduced=2, ks=(2, 4)).select("id").distinct().count() == 40
    assert trees.soft_clusters(rows.limit(0)).count() == 0
