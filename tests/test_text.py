import random

from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import chunking as ch
from graphloom.operators import context, evaluate, extraction, incremental


def one(frame, value, make):
    return frame([(value,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_scalar_text(frame):
    assert one(frame, " A&amp;B\tÉ-1 ", tx.clean) == "a b  1"
    assert one(frame, "The  Cat, a dog.", tx.normal_answer) == "cat dog"
    assert one(frame, None, tx.normal_answer) == ""
    assert one(frame, "a|b ; c||", lambda c: tx.split_markers(c, ["|", ";"])) == ["a", "b", "c"]
    assert [one(frame, v, lambda c: tx.number_or(c, 1.0)) for v in ("0.5", "-3", "x", "", None)] == [0.5, -3.0, 1.0, 1.0, 1.0]


def test_documents_and_windows(frame):
    docs = frame([(1, " a b c "), (2, "a b c"), (3, None), (4, " \n"), (5, " ".join(str(i) for i in range(130)))], "doc_id long, text string")
    deduped = ch.dedup_documents(docs)
    assert sorted((r.first_id, r.copies) for r in deduped.collect()) == [(1, 2), (5, 1)]
    rows = [r for r in ch.token_windows(deduped, 64, 16).collect() if r.tokens > 3]
    assert sorted((r.pos, r.tokens) for r in rows) == [(0, 64), (1, 64), (2, 34)]
    whole = [w for r in sorted(rows, key=lambda r: r.pos) for w in r.content.split()[16 if r.pos else 0:]]
    assert whole == [str(i) for i in range(130)]
    assert ch.token_windows(frame([("h", "")], "hash string, content string")).count() == 0


def test_running_index_and_increment(frame):
    values = list(range(57))
    random.Random(2).shuffle(values)
    rows = frame([(v,) for v in values], "v int")
    assert {r.v: r.chunk_index for r in ch.running_index(rows, "v").collect()} == {v: v for v in values}
    assert sorted(r.v for r in ch.split_increment(rows, 0.2, "v").filter("is_new").collect()) == list(range(46, 57))
    assert ch.split_increment(frame([], "v int"), 0.2, "v").count() == 0


def test_separator_chunks_respect_size(frame):
    text = "One two three. Four five six seven. " * 20 + "x" * 10 + " end"
    rows = ch.separator_chunks(frame([("h", text), ("n", None), ("e", "")], "hash string, content string"), size=12, overlap=2).collect()
    assert rows and all(r.tokens <= 12 and r.hash == "h" for r in rows)
    assert ch.merge_parts([5, 5, 5, 20, 1], 10) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert ch.merge_parts([], 10) == []


def test_extraction(frame):
    chunks = frame([("c1", "Agricultural PHENOMENON agricultural"), ("c2", None), (None, "agricultural phenomenon")], "chunk_id string, content string")
    assert sorted(tuple(r) for r in extraction.mentions(chunks).collect()) == [("c1", "agricultural"), ("c1", "phenomenon")]
    assert {(r.subject, r.object) for r in extraction.triples(chunks).collect()} == {("agricultural", "phenomenon"), ("phenomenon", "agricultural")}
    assert extraction.mentions(chunks, lambda texts: [["X Y"] if t else [] for t in texts]).collect()[0].entity == "x y"
    records = frame([('("relationship"<|>A<|>B<|>d<|>k<|>0.5)',), ('("relationship"<|>A<|>B<|>d<|>k)',), ("(x)",), (None,), ('("entity"<|>A<|>t<|>d)',)], "record string")
    assert sorted(r.weight for r in extraction.parse_relations(records).collect()) == [0.5, 1.0]
    assert extraction.parse_entities(records).count() == 1
    triples = frame([(["a", "b", "c"],), (["a", "b"],), (["a", "!", "c"],), (None,)], "triple array<string>")
    assert extraction.valid_triples(triples).count() == 1
    assert extraction.repair_json('say {"a": 1, "b": [2]} end') == {"a": 1, "b": [2]}
    assert extraction.repair_json('"a": true, b: 2.5, c: word') == {"a": True, "b": 2.5, "c": "word"}
    assert extraction.repair_json(None) == {}


def test_metrics(frame):
    rows = frame([(1, "The cat sat", "cat sat|dog"), (2, None, "x"), (3, "yes", "no"), (4, "", ""), (1, "The cat sat", "cat sat|dog")], "id long, output string, answer string")
    f1 = {r.id: r.f1 for r in evaluate.token_f1(rows).collect()}
    assert f1 == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert {r.id: r.em for r in evaluate.match(rows).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}
    assert {r.id: r.rouge_l for r in evaluate.rouge_l(rows).collect()}[1] == 1.0
    assert {r.id: r.bleu1 for r in evaluate.bleu1(rows).collect()}[1] == 1.0


def test_budget_groups(frame):
    rows = frame([("q", i, n) for i, n in enumerate([4, 5, 20, 3, 3])], "q string, pos int, t bigint")
    got = {r.pos: r.group_no for r in context.budget_groups(rows, 10, ["pos"], "t", ["q"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}


def test_state(frame):
    rows = frame([("a", 1, 5), ("a", 2, None), ("b", None, 1)], "k string, at int, v int")
    assert {r.k: r.v for r in incremental.latest(rows, ["k"], "at").collect()} == {"a": None, "b": 1}
    assert sorted(tuple(r) for r in incremental.upsert(rows, frame([("a", 9, 9)], "k string, at int, v int"), ["k"]).collect()) == [("a", 9, 9), ("b", None, 1)]
    packed = incremental.pack_buckets(frame([(1,)] * 12 + [(2,)] * 3 + [(3,)] * 4 + [(4,)] * 9, "bucket long"), 2, 10).collect()
    assert sum(r.part_rows for r in packed) == 28
    size = {}
    for r in packed:
        size[r.cluster] = size.get(r.cluster, 0) + r.part_rows
    assert max(size.values()) <= 10


def test_assignment_keeps_capacity(frame):
    nodes = frame([(f"n{i}", 0b1111) for i in range(6)], "node string, signature bigint")
    got = incremental.assign_by_signature(nodes, frame([("a", 0b1111, 0), ("b", 0b0111, 0)], "community string, signature bigint, n int"), 3).collect()
    assert sorted(r.community for r in got) == ["a", "a", "a", "b", "b", "b"]
